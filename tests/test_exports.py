"""Sinks in several steps, mergeable profiles, the memory table and SQL functions, on small tables."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from schedulesmith.functions import ops
from schedulesmith.functions.sql import FUNCTIONS, register_operations
from schedulesmith.operators import memory as mem
from schedulesmith.operators import profile as p
from schedulesmith.operators import structure as s
from schedulesmith.operators import validate as v
from schedulesmith.sources import sinks

KEYS = "file_id string, sheet_name string"


def typed(spark, rows):
    cleaned = spark.createDataFrame(rows, f"{KEYS}, row_idx bigint, City string, Zip string")
    return v.typed_table(v.enforce_columns(cleaned, ["file_id", "sheet_name", "row_idx"]))


def exported(spark, path, part="cleaned"):
    return sorted((str(r.file_id), str(r.sheet_name), r.row_idx, r.City) for r in sinks.read_cleaned(spark, path, part).collect())


def test_an_export_replaces_its_sheets_only(spark, tmp_path):
    path = str(tmp_path / "out")
    names = ["A B", "A_B", "A  B", "", None, "1", "01", "x/y", "é" * 120, "A_B-0123456789ab"]
    rows = [("f", n, i, f"{n} {i}", "1") for n in names for i in range(3)] + [("g", "A B", 0, "g", "2"), (None, "A B", 0, "n", "2")]
    sinks.write_cleaned(typed(spark, rows), path)
    assert exported(spark, path) == sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in rows)
    again = typed(spark, [("f", "A B", 7, "new", "1")])
    for _ in range(2):
        sinks.write_cleaned(again, path)
    want = sorted([(str(r[0]), str(r[1]), r[2], r[3]) for r in rows if r[:2] != ("f", "A B")] + [("f", "A B", 7, "new")])
    assert exported(spark, path) == want
    sinks.clear_cleaned(spark.createDataFrame([("f", "A_B"), ("f", "not there")], KEYS), path)
    assert exported(spark, path) == [r for r in want if r[:2] != ("f", "A_B")]


def test_the_primary_alias_follows_its_file(spark, tmp_path):
    path, table = str(tmp_path / "out"), typed(spark, [("f", "a", 0, "a", "1"), ("f", "b", 0, "b", "1"), ("g", "a", 0, "g", "1")])
    ranked = table.select("file_id", "sheet_name")
    sinks.write_cleaned(table, path, ranked.withColumn("is_primary", F.col("sheet_name") == "a"))
    assert exported(spark, path, "primary") == [("f", "a", 0, "a"), ("g", "a", 0, "g")]
    sinks.write_cleaned(table.where("file_id = 'f'"), path, ranked.withColumn("is_primary", F.col("sheet_name") == "b"))
    assert exported(spark, path, "primary") == [("f", "b", 0, "b"), ("g", "a", 0, "g")]


def test_rows_of_a_sheet_lie_sorted_in_one_file(spark, tmp_path):
    rows = [("f", n, (i * 37) % 500, "c", "1") for n in ("a", "b") for i in range(500)]
    sinks.write_cleaned(typed(spark, rows).repartition(7), str(tmp_path / "out"))
    for sheet in ("a", "b"):
        files = list((tmp_path / "out/cleaned/file=f" / f"sheet={sheet}").glob("*.parquet"))
        assert len(files) == 1
        assert [r.row_idx for r in spark.read.parquet(str(files[0])).collect()] == list(range(500))


def test_csv_sheets_with_one_safe_name_stay_apart(spark, tmp_path):
    rows = [("f", n, 0, f' {n}, "quoted"\nline ', "802") for n in ("A B", "A_B", "A  B")]
    sinks.write_cleaned_csv(typed(spark, rows), str(tmp_path / "csv"))
    found = {}
    for folder in (tmp_path / "csv/file=f").iterdir():
        read = spark.read.options(**sinks.READ_CSV).csv(str(folder)).collect()
        found[folder.name] = [(r.City, r.Zip) for r in read]
    assert len(found) == 3 and sorted(x for r in found.values() for x in r) == sorted((r[3], "00802") for r in rows)


def audit(spark, n, prefix="e"):
    columns = f"{KEYS}, " + ", ".join(f"{c} {'double' if c == 'confidence' else 'int' if c == 'row_index' else 'string'}" for c in sinks.AUDIT_COLUMNS)
    rows = [("f" if i % 2 else "g", "s", f"{prefix}{i}", "c", "t", "to_float" if i % 3 else "trim_whitespace", f" b{i}", str(i) if i % 3 != 2 else "n/a", 0.5, "human", "now", None, None)
            for i in range(n)]
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("form", ["csv", "json"])
def test_audit_entries_are_written_once(spark, tmp_path, form):
    path = str(tmp_path / "audit")
    for n in (4, 9, 9, 6):
        sinks.write_audit(audit(spark, n), path, "now") if form == "csv" else sinks.write_audit_json(audit(spark, n), path)
    if form == "csv":
        rows = spark.read.options(**sinks.READ_CSV).csv(path).collect()
        assert sorted((r["Entry ID"], r["Before Value"]) for r in rows) == sorted((f"e{i}", f" b{i}") for i in range(9))
        return
    rows = sinks.read_audit_json(spark, path).select("entry_id", F.schema_of_variant("after_value").alias("k"), F.variant_get("after_value", "$", "string").alias("x")).collect()
    want = {(f"e{i}", "BIGINT" if i % 3 == 1 else "STRING", str(i) if i % 3 != 2 else "n/a") for i in range(9)}
    assert len(rows) == 9 and {tuple(r) for r in rows} == want


def test_profiles_merge_without_shuffling_cells(spark):
    cells = spark.range(30_000).selectExpr("'f' as file_id", "cast(id % 3 as int) as col_idx", "id % 5 as part",
                                            "case id % 3 when 0 then cast(id as string) when 1 then concat('$', id % 40) else null end as value")
    keys = ["file_id", "col_idx"]
    parts = p.profile_parts(cells, [*keys, "part"], 2026)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_hll_sketch_agg" in plan
    got = {r.col_idx: r for r in p.finished_profiles(p.merge_profiles(parts, keys), keys).collect()}
    exact = {r.col_idx: r for r in p.column_profiles(cells, keys, 2026).collect()}
    for i, e in exact.items():
        for name in e.__fields__:
            if name != "unique_ratio":
                assert got[i][name] == pytest.approx(e[name]) if isinstance(e[name], float) else got[i][name] == e[name], name
    assert abs(got[0].n_distinct - 10_000) <= got[0].n_distinct_error < 700 and got[1].n_distinct == 40 and got[2].n_distinct == 0


def test_many_families_of_columns_make_one_plan(spark):
    def build(n):
        rows = spark.createDataFrame([("f", f"s{k}", i, ["c", f"{k}", None, "beyond"]) for k in range(n) for i in range(2)], f"{KEYS}, row_idx bigint, values array<string>")
        names = spark.createDataFrame([("f", f"s{k}", c, x) for k in range(n) for c, x in enumerate(["Common", f"own {k}`.\"", "Empty"])],
                                      f"{KEYS}, col_idx int, source_column string")
        return s.concat_records(rows, names)

    wide = build(40)
    assert wide.columns[3:] == ["Common", *sorted(f"own {k}`.\"" for k in range(40)), "Empty"]
    for r in wide.collect():
        k = r.sheet_name[1:]
        assert r.asDict() == {c: None for c in wide.columns} | {"file_id": "f", "sheet_name": r.sheet_name, "row_idx": r.row_idx, "Common": "c", f"own {k}`.\"": k}
    nodes = [len(build(n)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (3, 40)]
    assert nodes[0] == nodes[1]
    assert s.concat_records(wide.where("false").selectExpr("file_id", "sheet_name", "row_idx", "array('') as values"),
                            spark.createDataFrame([], f"{KEYS}, col_idx int, source_column string")).count() == 0


def test_memory_table_is_not_shuffled(spark, tmp_path):
    schema = "source_column string, target_field string, confidence double, ts timestamp"
    import datetime as dt
    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    batches = [[("Loc #", "Reference", 0.5, at(1)), ("City", "City", 0.9, at(2))], [("loc_#", "Reference", 0.7, at(1)), ("City", "County", 0.8, at(1))], [("CITY", "City", 0.1, at(1))]]
    table, whole = f"memory_{tmp_path.name.replace('-', '_')}", None
    mem.create_memory(spark, table, str(tmp_path / "m0"))
    for i, rows in enumerate(batches):
        entries = mem.memory_entries(spark.createDataFrame(rows, schema))
        mem.append_memory(entries, table)
        whole = mem.upsert_memory(whole if whole is not None else entries.limit(0), entries)
        if i == 1:
            mem.compact_memory(spark, table, str(tmp_path / "m1"))
    assert sorted(mem.read_memory(spark, table).collect()) == sorted(whole.select(mem.read_memory(spark, table).columns).collect())
    headers = spark.createDataFrame([("loc",), ("City",), ("none",)], "source_column string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mem.memory_matches(headers, mem.read_memory(spark, table))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # of the headers
        assert {r.source_column: r.target for r in found.collect()} == {"loc": "Reference", "City": "City"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sql_functions_equal_the_operations(spark):
    texts = ["$1,200.50", "(30)", " 7.0 ", "7.5", "abc", "", None, " n. y. ", "new york", "Y 13", "partial", "2024-1-5", "13/02/2024", "20240131", "Built 1987 x", "802", "00802-1234", "\xa0a  b "]
    data = spark.createDataFrame([(t,) for t in texts], "v string")
    register_operations(spark)
    register_operations(spark)
    typed_ops = {n: getattr(ops, n) for n in FUNCTIONS}
    for name, fn in typed_ops.items():
        got = spark.sql(f"select {name}(v) as x from {{d}}", d=data).collect()
        assert got == data.select(fn(F.col("v")).alias("x")).collect(), name
    with pytest.raises(AnalysisException):
        spark.sql("select drop_table('x')")
