import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from goldmatch.functions.cells import canonical_frame, normalize_value
from goldmatch.operators import compare
from goldmatch.operators.ordinals import row_ordinals, spread_positions

ROWS = "item_id long, side string, row_no long, cells array<string>"


def frames(spark, pairs):
    rows = [
        (i, side, no, list(r))
        for i, (gold, pred) in enumerate(pairs)
        for side, result in (("gold", gold), ("pred", pred))
        for no, r in enumerate(result)
    ]
    items = spark.createDataFrame([(i,) for i in range(len(pairs))], "item_id long")
    return items, spark.createDataFrame(rows, ROWS)


def verdicts(spark, pairs):
    items, rows = frames(spark, pairs)
    ordered = {r.item_id: r.is_equal for r in compare.ordered_compare(items, rows).collect()}
    bag = {r.item_id: r.is_equal for r in compare.bag_compare(items, rows).collect()}
    both = {r.item_id: r.same_bag for r in compare.differing_items(rows).collect()}
    n = range(len(pairs))
    # the combined operator must agree with the two single ones
    assert [i not in both for i in n] == [ordered[i] for i in n]
    assert [both.get(i, True) for i in n] == [bag[i] for i in n]
    return [(ordered[i], bag[i]) for i in n]


def test_known_pairs(spark):
    a, b = ("n:1", "s:Alice"), ("n:2", "s:Bob")
    pairs = [
        ([a, b], [a, b]),
        ([a, b], [b, a]),
        ([a, a, b], [a, b]),
        ([], []),
        ([], [a]),
        ([a], [a + ("n:3",)]),
        ([(None,), (None,)], [(None,), (None,)]),
        ([(None, "n:1")], [("n:1", None)]),
    ]
    assert verdicts(spark, pairs) == [
        (True, True), (False, True), (False, False), (True, True), (False, False), (False, False), (True, True), (False, False),
    ]


def test_random_pairs_agree_with_brute_force(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        gold = [(rng.choice(["n:1", "n:2", None]), rng.choice("xy")) for _ in range(rng.randint(0, 6))]
        pred = list(gold)
        for _ in range(rng.randint(0, 2)):
            change = rng.randint(0, 3)
            if change == 0:
                rng.shuffle(pred)
            elif change == 1 and pred:
                pred.pop(rng.randrange(len(pred)))
            elif change == 2 and pred:
                pred.append(rng.choice(pred))
            else:
                pred.append(("n:9", "x"))
        pairs.append((gold, pred))
    assert verdicts(spark, pairs) == [(g == p, Counter(g) == Counter(p)) for g, p in pairs]


def test_cap_reports_what_it_cuts(spark):
    items, rows = frames(spark, [([("n:1",)] * 4, [("n:1",)] * 2)])
    assert compare.cap_result_rows(rows, 3).count() == 5
    got = {r.side: (r.n_rows, r.kept_rows, r.truncated) for r in compare.truncated_results(rows, 3).collect()}
    assert got == {"gold": (4, 3, True), "pred": (2, 2, False)}
    assert compare.bag_compare(items, compare.cap_result_rows(rows, 2)).first().is_equal


def brute(rows):
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    return {(g, v): (i, len(vs)) for g, vs in groups.items() for i, v in enumerate(sorted(vs))}


def test_ordinals_of_hot_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), v) for v in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    want = brute(rows)
    for hot_rows in (100, 10**9):
        out = row_ordinals(df, ["g"], ["v"], size="n", hot_rows=hot_rows, sample=1.0)
        assert {(r.g, r.v): (r.row_no, r.n) for r in out.collect()} == want
        assert out.columns == ["g", "v", "row_no", "n"]


def test_positions_without_group(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = sorted((r.row_no, r.v) for r in spread_positions(df, [], ["v"]).collect())
    assert [v for _, v in got] == sorted(v for _, v in got)
    assert [n for n, _ in got] == list(range(5000))


def test_hot_group_is_spread_over_tasks(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    out = spread_positions(df, ["g"], ["v"])
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20000


def cells_of(spark, *expressions):
    row = canonical_frame(spark.sql("SELECT " + ", ".join(expressions))).first()
    return list(row.cells)


def test_numbers_of_all_types_agree(spark):
    for same in (
        ["10000000000000000", "1e16", "CAST(10000000000000000 AS DECIMAL(30,5))", "CAST(1e16 AS FLOAT) * CAST(1 AS DOUBLE)"][:3],
        ["CAST(2.50000 AS DECIMAL(10,5))", "2.5D", "CAST(2.5 AS FLOAT)", "2.50004D"],
        ["0", "-0.0D", "CAST(0 AS DECIMAL(5,2))", "CAST(0.00001 AS DECIMAL(8,5))", "false"],
        ["1.00005D * 0 + 100", "100", "CAST(100 AS DECIMAL(3,0))", "CAST(100 AS DECIMAL(20,10))"],
        ["9007199254740993", "CAST(9007199254740993 AS DECIMAL(20,0))"],
    ):
        assert len(set(cells_of(spark, *same))) == 1, same
    for apart in (
        ["CAST(12345678901234567.1 AS DECIMAL(30,1))", "CAST(12345678901234567.2 AS DECIMAL(30,1))"],
        ["9007199254740993", "9007199254740992D", "'9007199254740993'"],
        ["CAST(1.0001 AS DECIMAL(9,4))", "CAST(1.0002 AS DECIMAL(9,4))", "1.0003D"],
        ["CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)", "1e300", "1.5e39", "1e38"],
    ):
        assert len(set(cells_of(spark, *apart))) == len(apart), apart


def test_intervals_times_and_nested_cells(spark):
    assert len(set(cells_of(spark, "INTERVAL '2' DAY", "INTERVAL '48' HOUR", "INTERVAL '2 00:00' DAY TO MINUTE"))) == 1
    assert len(set(cells_of(spark, "INTERVAL '1' YEAR", "INTERVAL '12' MONTH", "INTERVAL '1' DAY"))) == 2
    assert cells_of(spark, "TIME '12:30:00'", "CAST(NULL AS INTERVAL DAY)", "CAST(NULL AS ARRAY<INT>)", "array()") == ["s:12:30:00", None, None, "a:[]"]
    equal = [
        ("array(1, 2.00001D, null)", "array(CAST(1 AS DECIMAL(5,3)), 2, null)"),
        ("array(' a', 'b')", "array('a', 'b\t')"),
        ("map('x', 1, 'y', 2)", "map('y', 2.0D, 'x', 1.0D)"),
        ("named_struct('p', 1, 'q', array(' z'))", "named_struct('r', 1.0D, 's', array('z'))"),
    ]
    for a, b in equal:
        one, other = cells_of(spark, a, b)
        assert one == other, (a, b)
    for a, b in (("array('a,b')", "array('a', 'b')"), ("array('1')", "array(1)"), ("array(array(1), array())", "array(array(), array(1))"), ("array('a\"', 'b')", "array('a', '\"b')"), ("map('x', 1)", "map('x', 2)")):
        one, other = cells_of(spark, a, b)
        assert one != other, (a, b)


def test_typed_rule_reaches_nested_values(spark):
    df = spark.sql("SELECT array(1.00004D, null) AS a, named_struct('s', ' x ', 'd', CAST(1.23456 AS DECIMAL(9,5))) AS s, map('k', 0.123456D) AS m, CAST(null AS STRUCT<x: DOUBLE>) AS n")
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.select(*[normalize_value(F.col(c), types[c]).alias(c) for c in df.columns]).first()
    assert row.a == [1.0, None] and row.s.s == "x" and str(row.s.d) == "1.2346" and row.m == {"k": 0.1235} and row.n is None


def test_capped_results(spark):
    rows = spark.createDataFrame([(i, side, n, ["x"]) for i, side, size in ((1, "gold", 5), (1, "pred", 3), (2, "gold", 2)) for n in range(size)], ROWS)
    got = sorted((r.item_id, r.side, r.row_no, r.truncated) for r in compare.capped_results(rows, 3).collect())
    assert got == [(1, "gold", n, True) for n in range(3)] + [(1, "pred", n, False) for n in range(3)] + [(2, "gold", n, False) for n in range(2)]
    assert compare.capped_results(rows.limit(0), 3).collect() == []


def test_positions_are_dealt_by_rows(spark):
    """A task gets a bounded number of rows, however small they are when compressed."""
    df = spark.range(3000).select((F.col("id") % 300).alias("g"), F.lit("same").alias("same"), F.col("id").alias("v"))
    out = row_ordinals(df, ["g"], ["v"], size="n", sample=1.0, task_rows=300)
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 5 and max(r["count"] for r in per_task) < 900
    plain = row_ordinals(df, ["g"], ["v"], size="n", sample=1.0)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in plain.collect()}
    assert row_ordinals(df.limit(0), ["g"], ["v"]).collect() == []
