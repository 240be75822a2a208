"""Line deduplication by a deletion-neighbourhood join over words.

A line is a sequence of words.  A line of at least ``MIN_WORDS`` words is dropped when a
line before it, in the order of (doc_id, line number), is within one word edit: equal
words, one word replaced, one inserted or one deleted.

With ``every_line``, as the query and the pipeline call it, every non-blank line takes
part: a shorter line is dropped when a line before it has equal words, as one changed
word of few makes a different line; and each character of a script written without
spaces (``SPACELESS``) is a word, so lines of such a script are long lines too.  Without
it shorter lines always stay and words are what stands between white space.

1. Every line that takes part gets a 128-bit key of its words; per key the first place
   stays, the later places are dropped.
2. Two long lines within one edit share the first or the last ``p`` words, where ``p`` is the
   largest power of two up to half the line.  Only lines that share such an end with a
   different line can have a partner (an exact test), and only these go on.
3. They emit the variants within the edit bound as hashed keys: the line without word
   ``i``, for every ``i`` outside a shared end, and the line itself.  A variant's hash
   combines one of each word with its place, so all of a line's variants come from
   running totals from both sides, however long the line.
4. Variants meet by equal keys.  A variant without word ``i`` meets the earliest line of
   the same length with the same ``i`` (a replaced word), and the earliest line that is
   the variant itself (a deleted word); that one meets the earliest longer line.  So
   each line gets few candidates, never all pairs, even where thousands share a key.
   The words of every candidate pair are compared before a line is dropped.

Each row of the input is written once with a key of its own (``__row``), by which dropped
lines are cut.  A line is hashed as one string; words are taken only from the first place
of a line that can have a partner.

Cases: null text stays null and has no lines; null ids are last in the order; rows that
share an id, or have none, stand in the order of their keys, so the first of equal rows
keeps its lines and a line that occurs nowhere else stays in every case; blank lines and
line ends stay; white space inside a line and the case of A-Z do not count; an empty table
gives an empty result; other columns pass through, but ``n_lines`` and ``n_dropped`` are
replaced unless ``counts`` is false.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import maybe_wanted
from emberwatch.storage import stage

MIN_WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER_SPACE = "\t\x0b\f\r"
# Thai, Lao, Tibetan, Myanmar; Khmer; kana and Han: as ranges, since Java looks up a
# character's script several times as slowly.
SPACELESS = (
    r"[\u0E00-\u109F\u1780-\u17FF\u19E0-\u19FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF"
    r"\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}]"
)


def _normal(lines: DataFrame, every_line: bool) -> DataFrame:
    """``line`` as its words with one space between them, in ``plain``."""
    line = F.col("line")
    ascii_only = F.octet_length(line) == F.char_length(line)
    # Case is folded for A-Z alone; the quick way does just that to ASCII.
    other = F.translate(line, UPPER, LOWER)
    if every_line:
        other = F.regexp_replace(other, SPACELESS, " $0 ")
    folded = lines.withColumn("plain", F.when(ascii_only, F.lower(line)).otherwise(other))
    odd = reduce(or_, (F.contains("plain", F.lit(x)) for x in [*OTHER_SPACE, "  "]))
    one_space = F.regexp_replace("plain", f"[ {OTHER_SPACE}]+", " ")
    return folded.withColumn("plain", F.trim(F.when(odd, one_space).otherwise(F.col("plain"))))


def _lines(docs: DataFrame, every_line: bool) -> DataFrame:
    """doc_id, row, line_no, k1, k2 of each line that takes part, and of a long one ``ends``."""
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plain = F.col("plain")
    spaces = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit("")))
    counted = _normal(lines, every_line).select(
        "doc_id", "row", "line_no", "plain",
        F.when(plain == "", 0).otherwise(spaces + 1).alias("n"),
        F.monotonically_increasing_id().alias("barrier"),
    )
    # The filter reads the task's numbers, so it stays above the steps that make lines plain,
    # and these are taken once per line.
    least = 1 if every_line else MIN_WORDS
    return counted.where((F.col("n") >= least) & (F.col("barrier") >= 0)).select(
        "doc_id", "row", "line_no",
        plain_hash("k1"), plain_hash("k2", "second"),
        # Shorter lines meet by their keys alone.
        F.when(F.col("n") >= MIN_WORDS, _ends()).alias("ends"),
    )


def plain_hash(name: str, *seed: str) -> Column:
    return F.xxhash64(*[F.lit(x) for x in seed], "plain").alias(name)


def _place() -> Column:
    """Order of lines; rows without an id come last."""
    late = F.col("doc_id").isNull()
    return F.struct(late.alias("late"), F.col("doc_id"), F.col("row"), F.col("line_no"))


def _half(n: Column) -> Column:
    """The largest power of two up to n / 2."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.floor(n / 2).cast("double") + 0.25))).cast("int")


def _ends() -> Column:
    """Hashes of the first and last words, for a line's own length and for one word less."""
    plain, n = F.col("plain"), F.col("n")
    p, q = _half(n), _half(n - 1)

    def both(size: Column) -> Column:
        first, last = (F.call_function("substring_index", plain, F.lit(" "), x) for x in (size, -size))
        return F.array(F.xxhash64(F.lit("first"), first), F.xxhash64(F.lit("last"), last))

    return F.when(p == q, both(p)).otherwise(F.concat(both(p), both(q)))


def _with_partner(lines: DataFrame) -> DataFrame:
    """Lines that share an end with a different line: their first place and the shared ends.

    ``shared`` has 0 for the first and 1 for the last words, 2 and 3 for those of one word less.
    """
    ends = lines.select("k1", "k2", "doc_id", "row", "line_no", F.posexplode("ends").alias("which", "end"))
    shared = (
        ends.groupBy("end")
        .agg(F.min("k1").alias("low"), F.max("k1").alias("high"))
        .where("low != high")
        .select("end")
    )
    shared = stage(shared, "line_ends")
    return (
        maybe_wanted(ends, "end", shared)
        .join(shared, "end", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.min(_place()).alias("place"), F.collect_set("which").alias("shared"))
    )


def _candidates(docs: DataFrame, partners: DataFrame, every_line: bool) -> DataFrame:
    """The words of the partner lines, from the rows that have them first."""
    wanted = partners.groupBy(F.col("place.row").alias("row")).agg(
        F.collect_list(F.struct("place", "k1", "k2", "shared")).alias("wanted")
    )
    texts = docs.select("row", "text").join(wanted, "row").select("wanted", F.split("text", "\n").alias("all"))
    # ``all`` is read in two places, so it is split once and not for each line.
    found = F.transform("wanted", lambda x: F.struct(x.alias("x"), F.get("all", x["place"]["line_no"]).alias("line")))
    lines = texts.select(F.explode(F.when(F.size("all") > 0, found)).alias("at")).select("at.x.*", "at.line")
    words = _normal(lines, every_line).withColumn("words", F.split("plain", " "))
    # ``line`` is fixed once written, and short to carry.
    return words.select(
        "k1", "k2", "place", "shared", "words", F.size("words").alias("n"),
        F.monotonically_increasing_id().alias("line"),
    )


def _variants(candidates: DataFrame) -> DataFrame:
    """(v1, v2, i, line): the line itself with i 0, and without each word i."""
    n, i = F.col("n"), F.col("i")
    p, q = _half(n), _half(n - 1)
    has = lambda which: F.array_contains("shared", which)
    # Words outside a shared end are those after ``low`` and those up to ``high``.
    low = F.least(F.when(has(0), p), F.when(has(2), q), n)
    high = F.greatest(F.when(has(1), n - p), F.when(has(3), n - q), F.lit(0))
    bounds = candidates.select("line", "n", "words", low.alias("low"), high.alias("high"))
    # Each word carries only what its variants need: the rest is looked up by line.
    words = bounds.select("line", "n", "low", "high", F.posexplode("words").alias("at", "word")).select(
        "line", (F.col("at") + 1).alias("i"), "word",
        ((F.col("at") >= F.col("low")) | (F.col("at") < F.col("high"))).alias("inside"),
        (F.col("at") + 1 == n).alias("last"),
    )
    in_line = Window.partitionBy("line").orderBy("i")
    before = in_line.rowsBetween(Window.unboundedPreceding, -1)

    def total_after(moved: Column) -> Column:
        # The whole line's total without that up to here.
        whole = F.bit_xor(moved).over(Window.partitionBy("line"))
        return whole.bitwiseXOR(F.bit_xor(moved).over(in_line))

    def totals(seed: int) -> dict[str, Column]:
        # A word stands in its own place before the missing word and one earlier after it.
        own, moved = F.xxhash64(F.lit(seed), "word", "i"), F.xxhash64(F.lit(seed), "word", i - 1)
        head = F.coalesce(F.bit_xor(own).over(before), F.lit(0))
        return {
            f"v{seed}": head.bitwiseXOR(total_after(moved)),
            f"w{seed}": head.bitwiseXOR(own),
        }

    hashed = words.withColumns(totals(1) | totals(2))
    # Both kinds from one pass: unlike a union, it orders the words of a line once.
    cut = F.when(F.col("inside"), F.struct("v1", "v2", "i"))
    own = F.when(F.col("last"), F.struct(F.col("w1").alias("v1"), F.col("w2").alias("v2"), F.lit(0).alias("i")))
    return (
        hashed.where("inside or last")
        .select("line", F.explode(F.array(cut, own)).alias("variant"))
        .where("variant is not null")
        .select("variant.v1", "variant.v2", "variant.i", "line")
    )


def _candidate_pairs(variants: DataFrame, places: DataFrame) -> DataFrame:
    """(before, line): earlier candidates for each line; ``places`` has line, n, place."""
    shared = (
        variants.groupBy("v1")
        .agg(F.min("line").alias("low"), F.max("line").alias("high"))
        .where("low != high")
        .select("v1")
    )
    shared = stage(shared, "line_shared_variants")
    met = maybe_wanted(variants, "v1", shared).join(shared, "v1", "left_semi")
    met = stage(met.join(places, "line"), "line_variants")
    first = F.min(F.struct("place", "line"))
    same = stage(met.groupBy("v1", "v2", "n", "i").agg(first.alias("first")), "line_first_variants")
    whole = same.where("i = 0").select("v1", "v2", F.col("first").alias("shorter"))
    longer = same.where("i > 0").groupBy("v1", "v2").agg(F.min("first").alias("longer"))
    cut, own = met.where("i > 0"), met.where("i = 0")
    replaced = cut.join(same, ["v1", "v2", "n", "i"]).select("line", "place", "first")
    deleted = cut.join(whole, ["v1", "v2"]).select("line", "place", F.col("shorter").alias("first"))
    inserted = own.join(longer, ["v1", "v2"]).select("line", "place", F.col("longer").alias("first"))
    return (
        replaced.unionByName(deleted)
        .unionByName(inserted)
        .where(F.col("first.place") < F.col("place"))
        .select(F.col("first.line").alias("before"), "line")
        .distinct()
    )


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by one replaced, inserted or deleted word."""
    longer = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    shorter = F.when(F.size(a) >= F.size(b), b).otherwise(a)
    gap = F.size(longer) - F.size(shorter)
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    # The first difference; what follows it must be equal, past the longer one's extra word.
    at = F.array_position(differs, F.lit(True)).cast("int")
    rest = F.greatest(F.size(longer) - at, F.lit(0))
    tail = F.slice(longer, at + 1, rest) == F.slice(shorter, at + 1 - gap, rest)
    return (gap <= 1) & ((at == 0) | tail)


def dropped_lines(docs: DataFrame, every_line: bool = False) -> DataFrame:
    """(row, line_no) of every line to drop; ``docs`` has doc_id, text and a key ``row`` per row."""
    lines = stage(_lines(docs, every_line), "line_keys")
    partners = stage(_with_partner(lines), "line_partners")
    candidates = stage(_candidates(docs, partners, every_line), "line_candidates")
    places = candidates.select("line", "n", "place")
    pairs = stage(_candidate_pairs(_variants(candidates), places), "line_pairs")
    own = candidates.select("line", "k1", "k2", "words")
    earlier = candidates.select(F.col("line").alias("before"), F.col("words").alias("other"))
    near = (
        pairs.join(own, "line")
        .join(earlier, "before")
        .where(_one_edit(F.col("words"), F.col("other")))
        .select("k1", "k2", F.lit(True).alias("near"))
        .distinct()
    )
    # Lines of which something is to be dropped: they have an earlier partner or repeats.
    wanted = (
        lines.groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(stage(near, "line_near"), ["k1", "k2"], "left")
        .where("near or times > 1")
        .select("k1", "k2", F.coalesce("near", F.lit(False)).alias("near"))
    )
    wanted = stage(wanted, "line_wanted")
    repeated = maybe_wanted(lines.select("k1", "k2", _place().alias("place")), "k1", wanted)
    places = stage(repeated.join(wanted, ["k1", "k2"]), "line_places")
    # Written by itself, so that a frequent line's places are joined where they lie or split.
    first = stage(places.groupBy("k1", "k2").agg(F.min("place").alias("first")), "line_first_places")
    gone = places.join(first, ["k1", "k2"]).where("near or place > first")
    return gone.select("place.row", "place.line_no")


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every_line: bool = False, counts: bool = True
) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, plus n_lines and n_dropped with ``counts``."""
    keyed = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "line_docs")
    source = keyed.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col("__row").alias("row")
    )
    per_row = (
        stage(dropped_lines(source, every_line), "line_dropped")
        .groupBy(F.col("row").alias("__row"))
        .agg(F.collect_set("line_no").alias("__gone"))
    )
    joined = keyed.join(per_row, "__row", "left").withColumn("__lines", F.split(F.col(text), "\n"))
    lines = F.col("__lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    kept = F.transform(stay, lambda at: F.get(lines, at))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = {text: cleaned}
    if counts:
        columns["n_lines"] = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
        columns["n_dropped"] = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    return joined.withColumns(columns).drop("__row", "__gone", "__lines")
