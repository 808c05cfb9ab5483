"""Definitions of abbreviations beside a plain loop, and what rows see of them."""

from termloom.operators import abbreviations as A


def aligned(short, before):
    """From right to left, one character at a time."""
    i, at = len(short) - 1, len(before)
    while i >= 0:
        c = short[i].lower()
        if not c.isalnum():
            i -= 1
            continue
        at -= 1
        while at >= 0 and (before[at].lower() != c or i == 0 and at > 0 and before[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return None
        i -= 1
    return before[at:] if len(before) - at > len(short) else None


CASES = [
    ("status of hypertension (HTN) was recorded", "HTN", "hypertension"),
    ("the heat shock transcription factor (HSF)", "HSF", "heat shock transcription factor"),
    ("with body mass index (BMI)", "BMI", "body mass index"),
    ("tumour necrosis factor alpha (TNF-a)", "TNF-a", "tumour necrosis factor alpha"),
    ("Deoxyribonucleic acid (DNA)", "DNA", "Deoxyribonucleic acid"),
    ("an interleukin-6 (IL-6)", "IL-6", "interleukin-6"),
    ("see the table (left panel)", "left panel", None),
    ("nothing here (XQZ)", "XQZ", None),
    ("short (ab cd ef)", "ab cd ef", None),
    ("a numeral (12)", "12", None),
    ("(ABC) first of all", "ABC", None),
    ("first (x) then second thing (ST)", "ST", "second thing"),
    ("an open one (BMI", "BMI", None),
    ("aaaaaaaaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab (aaaaaaaaab)", "aaaaaaaaab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"),
    ("ein Ärger über Öl (ÄÖ)", "ÄÖ", "Ärger über Öl"),
]


def test_definitions(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)] + [(99, None), (98, "")], "k int, t string")
    got = {(r.k, r.short): r.long for r in A.definitions(rows, "t", ["k"]).collect()}
    assert got == {(k, s): w for k, (_, s, w) in enumerate(CASES) if w}
    for _, short, want in CASES:
        if want:
            assert aligned(short, want) == want
    assert A.definitions(rows.limit(0), "t", ["k"]).count() == 0


def test_alignment_is_the_loop(spark):
    import random

    dice = random.Random(7)
    word = lambda: "".join(dice.choice("abcAB-") for _ in range(dice.randint(1, 6)))
    pairs = [("".join(dice.choice("abcB-") for _ in range(dice.randint(2, 5))), " ".join(word() for _ in range(dice.randint(1, 6)))) for _ in range(400)]
    pairs = [(s, b) for s, b in pairs if s[0].isalnum()]
    df = spark.createDataFrame(pairs, "short string, before string")
    for r in df.select("short", "before", A.long_form(df.short, df.before).alias("long")).collect():
        assert r.long == aligned(r.short, r.before), r


def test_rows_see_what_was_before(spark):
    texts = ["BMI unknown", "body mass index (BMI) and bmi", "the BMI; again", "big money inside (BMI) then basic moves (BM) or best mates (BM)", "bmi, bm BMI", "nothing", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = sorted(tuple(r) for r in A.expanded(rows, "t", "k").collect())
    assert got == [(2, "bmi", "body mass index"), (3, "bmi", "body mass index"), (4, "bm", "best mates"), (4, "bmi", "big money inside")]
    assert sorted(tuple(r) for r in A.expanded(rows.repartition(5), "t", "k").collect()) == got
    assert A.expanded(rows.limit(0), "t", "k").count() == 0


def test_ranges_are_found_by_halving(spark):
    from pyspark.sql import functions as F

    from termloom.operators import ordering

    for n in (0, 1, 2, 31, 32, 700):
        cuts = [float(3 * k) for k in range(n)]
        held = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
        df = spark.createDataFrame([(None,), (float("nan"),), *((x / 2,) for x in range(-3, 6 * n + 3, 5))], "x double")
        plain = F.size(F.filter(held, lambda c: c < F.col("x")))
        assert df.where(ordering.below(held, n, F.col("x")) != plain).count() == 0 and df.where(ordering.below(held, n, F.col("x")).isNull()).count() == 0


def test_work_of_a_row_does_not_grow_with_ranges(spark):
    from termloom.operators import ordering

    df = ordering.ranged(spark.range(3000).withColumnRenamed("id", "x"), "x", 300).selectExpr("transform(array(_range), r -> r) AS r")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "filter([" not in plan
    at = [r.r[0] for r in df.collect()]
    assert at == sorted(at) and at[0] == 0 and 250 < at[-1] < 300
