import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.config import load_mappings, load_pattern_rules
from emberwatch.functions import clock, free_text, network, text
from emberwatch.plans import profile


def column(spark, values, expression):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(3)
    values = ["::", "1::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    for _ in range(1500):
        parts = rng.choices(["", "0", "ab", "12345", "ffff", "1.2.3.4", "g"], [4, 3, 3, 0.3, 3, 1, 0.3], k=rng.randint(2, 9))
        values.append(":".join(parts))
        values.append(".".join(str(rng.choice([0, 1, 9, 99, 255, 256, "01", ""])) for _ in range(rng.randint(3, 5))))

    def valid(value):
        try:
            ipaddress.ip_address(value)
            return True
        except ValueError:
            return False

    assert column(spark, values, network.looks_like_ip) == [valid(v) for v in values]


def test_timestamps(spark):
    cases = {
        "2026-08-10T08:30:00.000Z": 1786350600000000,
        "2026-08-10 08:30": 1786350600000000,
        "2026-08-10T08": 1786348800000000,
        "2026-08-10T08:30:00.1234567+07:00": 1786325400123456,
        "2026-08-10": 1786320000000000,
        "2026-8-1": None, "2026": None, "T08:30": None, "20260810T083000": None,
        "2026-02-30": None, "": None,
    }
    got = column(spark, list(cases), lambda v: F.unix_micros(clock.iso_timestamp(v)))
    assert got == list(cases.values())
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
    try:
        assert column(spark, list(cases), lambda v: F.unix_micros(clock.iso_timestamp(v))) == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_epochs_round_like_floating_seconds(spark):
    rng = random.Random(5)
    values = [rng.randrange(10**17, 2 * 10**18) for _ in range(500)]
    values += [rng.randrange(10**14, 10**17) for _ in range(300)]
    values += [rng.randrange(10**11, 10**14) for _ in range(200)] + [0, -5, 1786350600]

    def expected(epoch):
        for lower, unit in ((10**17, 10**9), (10**14, 10**6), (10**11, 10**3)):
            if abs(epoch) >= lower:
                seconds = epoch / unit
                break
        else:
            seconds = epoch
        whole = int(seconds)
        return whole * 1_000_000 + round((seconds - whole) * 1_000_000)

    in_range = [v for v in values if abs(expected(v)) < 253402300800 * 1_000_000]
    got = column(spark, [str(v) for v in in_range], lambda v: F.unix_micros(clock.epoch_timestamp(v)))
    assert got == [expected(v) for v in in_range]


def test_free_text(spark):
    values = [
        'a=1 srcip="1.1.1.1" dstip=2.2.2.2 ACTION=Deny proto=17 srcip=3.3.3.3 dstport=53',
        "a=1 srcip=1.1.1.1 x 127.0.0.1 8.8.8.8",
        "sshd: Failed password for root from 9.9.9.9 port 22 ssh2",
        "nothing here",
    ]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["x"].asDict() for r in frame.select(free_text.extract_from_text(F.col("v")).alias("x")).collect()]
    assert (got[0]["srcip"], got[0]["dstip"], got[0]["proto"]) == ("3.3.3.3", "2.2.2.2", "17")
    assert (got[0]["action"], got[0]["severity"]) == ("connection_blocked", 3)
    assert (got[1]["srcip"], got[1]["dstip"], got[1]["action"]) == ("1.1.1.1", "8.8.8.8", None)
    assert (got[2]["user"], got[2]["dstport"], got[2]["severity"]) == ("root", "22", 3)
    assert set(got[3].values()) == {None}


def test_words_and_numbers(spark):
    assert column(spark, [" 5 ", "+7", "22.0", "x", None], text.safe_int) == [5, 7, None, None, None]
    assert column(
        spark, ["Brute Force", "", None], lambda v: text.first_keyword_value(v, [("brute", "a"), ("force", "b")])
    ) == ["a", None, None]


def test_trust_entries():
    config = {"known_scanners": {"ips": ["b", 5], "subnets": None}, "trusted_hosts": {"ips": ["a", "b"]}}
    assert network.trust_entries(config) == ["a", "b"]
    assert network.trust_entries(None) == []


def test_config(tmp_path):
    path = tmp_path / "detection.json"
    path.write_text(
        '{"patterns": [{"name": "brute_force", "min_events": 4},'
        ' {"name": "lateral_movement", "dst_ports": [22], "min_unique_dst_hosts": 2}]}'
    )
    rules = load_pattern_rules(str(path))
    assert rules.thresholds["brute_force_failures"] == 4
    assert rules.thresholds["exfil_events"] == 50
    assert rules.lateral_ports == (22,)
    assert load_mappings({"Wazuh": {"My.Col": "data.srcip"}}) == {"wazuh": {"my.col": "data.srcip"}}
    assert load_mappings(None) is None


@pytest.mark.parametrize("sample,expected", [(None, {"ok": 7, "bad": 3}), (4, {"ok": 2, "bad": 2})])
def test_profile(spark, tmp_path, sample, expected):
    from emberwatch.sources.csv_export import csv_columns, parse_csv_rows, read_csv_cells

    times = ["soon", "2026-08-10", "soon", "2026-08-10", "soon"] + ["2026-08-10"] * 5
    path = tmp_path / "x.csv"
    path.write_text("@timestamp,rule.id,agent.name,odd\n" + "".join(f"{t},{i},H,v{i % 4}\n" for i, t in enumerate(times)))
    columns = csv_columns(spark, str(path))
    cells = read_csv_cells(spark, str(path), columns)
    documents = parse_csv_rows(cells, columns, "wazuh")
    outcomes = {
        "ok" if r["outcome"] == "ok" else "bad": r["n_rows"]
        for r in profile.profile_normalize(documents, "wazuh", sample).collect()
    }
    assert outcomes == expected
    status = {r["column"]: r["status"] for r in profile.profile_mapping(spark, columns).collect()}
    assert status == {"@timestamp": "mapped", "rule.id": "native", "agent.name": "native", "odd": "unmapped"}
    assert profile.missing_columns(columns) == ["rule.level"]
    hints = profile.profile_suggestions(spark, cells, columns, sample_rows=sample).collect()
    assert [(r["column"], r["samples"]) for r in hints] == [("odd", "v0, v1, v2")]
    assert profile.profile_yield(documents).first().asDict() == {
        "total_rows": 10, "parsed": 10, "skipped": 0, "percent": 100.0,
    }
    distinct = {r["column"]: r["n_distinct"] for r in profile.profile_values(cells, columns, sample).collect()}
    assert distinct["odd"] == 4


def _known(spark, addresses, trust, match="cidr"):
    from emberwatch.operators.trust import trust_table, trusted_addresses

    rows = spark.createDataFrame([(a,) for a in addresses], "ip string")
    return {r["ip"] for r in trusted_addresses(rows, trust_table(spark, trust), match).collect()}


def test_trust_entries_that_are_no_network(spark):
    trust = {"trusted_hosts": {"ips": ["printer-7"], "subnets": ["172.19.4.0/22"]}}
    assert _known(spark, ["172.19.6.9", "172.19.9.9", "printer-7", None, ""], trust) == {"172.19.6.9"}
    assert _known(spark, ["printer-7", "x"], trust, "prefix") == {"printer-7"}
    assert _known(spark, ["10.0.0.1"], None) == set()


def test_trusted_networks_against_the_standard_library(spark):
    import ipaddress
    import random

    draw = random.Random(11)
    entries = ["0.0.0.0/1", "::/3", "10.1.2.3", "2001:db8::1", "bad", "1.2.3.4/33"]
    for _ in range(60):
        version, size = draw.choice([(4, draw.randrange(4, 33)), (6, draw.randrange(4, 129))])
        kind = ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address
        entries.append(f"{kind(draw.getrandbits(32 if version == 4 else 128))}/{size}")
    networks = [ipaddress.ip_network(e, strict=False) for e in entries if "bad" not in e and "/33" not in e]
    addresses = ["", "::", "255.255.255.255", "10.1.2.3", "2001:DB8:0:0::1", "10.1.2.3/8", "fe80::1%eth0"]
    for net in networks:  # the first and last of each, and their neighbours
        for number in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= number < 2**net.max_prefixlen:
                addresses.append(str(type(net[0])(number)))
    table = spark.createDataFrame([(e, 1) for e in entries], "network string, entry int")

    def inside(text):
        try:
            address = ipaddress.ip_address(text.partition("%")[0])
        except ValueError:
            return False
        return any(address.version == net.version and address in net for net in networks)

    wanted = {a for a in addresses if inside(a)}
    assert _known(spark, addresses, table) == wanted
    assert 50 < len(wanted) < len(set(addresses))


def test_many_maintenance_events_keep_an_int_delta(spark):
    from emberwatch.operators.detect import indicators

    delta = next(d for code, _, d, _ in indicators() if code == "FP6")
    row = spark.createDataFrame([(200_000_000,)], "n_maintenance long").select(delta.alias("d")).first()
    assert row["d"] == -2_000_000_000
