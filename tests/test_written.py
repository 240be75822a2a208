from workload import queries


def test_names_are_written_together_as_three_files_each(spark, tmp_path):
    made = {n: spark.range(30).selectExpr(f"concat('{n}', id) AS line") for n in ("x", "y")}
    queries._written_together(made, str(tmp_path))
    for name in made:
        read = spark.read.text([str(tmp_path / f"{name}-{i}.json") for i in range(3)])
        assert sorted(r[0] for r in read.collect()) == sorted(f"{name}{i}" for i in range(30))
