"""Edge cases of expressions and operators."""

import json
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from termloom import providers
from termloom.functions import gold as G
from termloom.functions import identity as I
from termloom.functions import numbers as N
from termloom.functions import statistics
from termloom.functions import text as T
from termloom.operators import calibrate, candidates, compare, decide, hierarchy, routing, runs, score, validate
from termloom.plans import disabled
from termloom.schemas import assert_columns, blank_to_null, violations


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_identity(spark):
    s = lambda x: F.lit(x).cast("string")
    none = s(None)
    assert one(spark, I.canonical(s(" hp ")), I.canonical(s("")), I.canonical(none), I.canonical(s("zfin"))) == ("HPO", None, None, "ZFIN")
    assert one(spark, I.normalized_code(s("A_B_1"), s("hpo")), I.normalized_code(s("1234-5"), s("LOINC")), I.normalized_code(s("ICD10CM:A1"), none)) == ("A:B:1", "LOINC:1234-5", "ICD10:A1")
    assert one(spark, I.inconsistency(s("HPO"), s("HP:HP:1"), none), I.inconsistency(s("UNKNOWN"), s("UNKNOWN:UNMAPPED"), none), I.inconsistency(s("LOINC"), s("LOINC:x"), none)) == ("nested code namespace", None, "no valid identifier")
    assert one(spark, I.resolved(s("HP:1"), s("http://a/MONDO_1"), none, none))[0] is None
    assert tuple(one(spark, I.resolved(s(""), s("http://a/MONDO_1"), none, s("HPO")))[0]) == ("MONDO:1", "MONDO", "iri")
    efo = F.array(F.lit("EFO"))
    assert one(spark, I.eligible(s("HPO"), efo, efo), I.eligible(s("HPO"), efo, efo, strict=True), I.eligible(s("HPO"), efo, F.lit(None).cast("array<string>"))) == (True, False, True)


def test_gold(spark):
    s = lambda *x: F.array(*[F.lit(v).cast("string") for v in x])
    assert one(spark, G.split_codes(F.lit("A1 |  B2 | |C|D")), G.split_codes(F.lit("A1|B2 | "), exact=False)) == (["A1", "B2", "|C|D"], ["A1", "B2"])
    assert one(spark, G.first_gold_rank(s(None, "b", "a"), s("a", "b")), G.first_gold_rank(s("x"), s())) == (2, None)
    assert one(spark, G.recall_at_gold(s("a", "x", "b"), s("a", "b")), G.recall_at_gold(s("a"), s())) == (0.5, None)
    assert one(spark, G.same_set(s("a", None, "b"), s("b", "a", "a"))) == (True,)
    assert tuple(one(spark, G.fractional(F.lit(True), F.lit(2), s("a")))[0]) == (0.5, 0.25, 0.25, 0.0)
    assert tuple(one(spark, G.fractional(F.lit(False), F.lit(None).cast("int"), s()))[0]) == (0.0, 0.0, 0.0, 1.0)


def test_numbers(spark):
    d = lambda x: F.lit(x).cast("double")
    assert one(spark, *[N.clamp_unit(d(x)) for x in (1.0000001192092896, 1.5, -0.1, float("nan"), float("inf"), -1e-7)]) == (1.0, None, None, None, None, 0.0)
    assert one(spark, N.rate(F.lit(1), F.lit(0)), N.rate(F.lit(1), F.lit(0), empty=0.0)) == (None, 0.0)
    n = F.lit(None).cast("int")
    assert one(spark, N.cost(n, n, n, d(1), d(1), d(1)), N.cost(F.lit(1000000), F.lit(2000000), n, d(2), d(1), d(1))) == (None, 1.0)


def test_texts(spark):
    s = F.lit
    assert one(spark, T.explanation(s("Mean systolic pressure")), T.explanation(s("Left arm pressure")), T.explanation(s("??")))[0:3] == ("Use if the field stores an average across repeated measurements.", "Use if the measurement site is specifically the left arm.", "Use only if the field specifically means this candidate concept.")
    assert one(spark, T.without_fences(s("```json\n{}\n```")), T.readable(s("htnDiag_age")), T.slug(s(" A b/c ")), T.bounded(s("abcdef"), 3)) == ("{}", "htn Diag age", "a-b-c", "abc...")
    assert one(spark, T.safe_message(s("bad api_key=abcdef12 " + "x" * 600)))[0].startswith("bad ***REDACTED*** xxx")
    assert one(spark, T.gold_curie(s("Orphanet:Café "))) == ("ORDO:Café",)
    assert one(spark, blank_to_null(s(" NaN ")), blank_to_null(s(" a "))) == (None, "a")


def test_schemas(spark):
    df = spark.range(2)
    with pytest.raises(ValueError, match="b"):
        assert_columns(df, ["id", "b"])
    assert [r.violations for r in violations(df, {"positive": F.col("id") > 0}).orderBy("id").collect()] == [["positive"], []]


def test_routing(spark):
    none, arr = F.lit(None).cast("string"), lambda *x: F.array(*[F.lit(v) for v in x])
    null = F.lit(None).cast("array<string>")
    got = one(spark, routing.ontologies_of(F.lit("hp"), none, null, null), routing.ontologies_of(F.lit("hp"), none, null, arr("LOINC")), routing.ontologies_of(none, F.lit("EFO"), arr("HP"), arr("hpo")), routing.ontologies_of(none, none, null, arr("LOINC", "UO")))
    assert got == (["HPO"], [], ["HPO"], ["LOINC", "UO"])


def test_hierarchy_cycles_and_unknown_nodes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "p"), ("d", "p"), ("c", "o"), ("d", "o")], "subject string, object string")
    pairs = spark.createDataFrame([(1, "a", ["b"]), (2, "c", ["d"]), (3, "z", ["a"]), (4, None, ["a"]), (5, "c", []), (6, "p", ["x", "c"]), (7, "c", ["d", "c"])], "id int, predicted string, gold array<string>")
    got = {r.id: (r.relationship, r.matched_gold, r.shared_parent) for r in hierarchy.related(pairs, e, hierarchy.closure(e)).collect()}
    assert got == {1: ("More Specific", "b", None), 2: ("Sibling", "d", "o"), 3: ("Unrelated", None, None), 4: ("Not Applicable", None, None), 5: ("Not Applicable", None, None), 6: ("More General", "c", None), 7: ("Same", "c", None)}


def test_calibration_edges(spark):
    one_class = spark.createDataFrame([(1, 0.5), (1, 1.0)], "label int, score double")
    assert tuple(calibrate.roc_auc(one_class).first()) == (2, 0, None, "NOT_COMPUTABLE")
    assert [r["count"] for r in calibrate.bins(one_class).orderBy("bin").collect()] == [0, 0, 0, 0, 0, 1, 0, 0, 0, 1]
    assert calibrate.ece(calibrate.bins(one_class.limit(0))).first()[0] is None
    assert abs(one(spark, calibrate.p_value(F.lit(1.959963984540054)))[0] - 0.05) < 1e-9
    both = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], "label int, score double")
    r = calibrate.separation(both).first()
    assert abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-12


def test_decisions_and_results(spark):
    req = spark.createDataFrame([(1, "t1", "l"), (2, "t2", None), (3, "t3", None), (4, "t4", None)], "request_id bigint, term string, label string").withColumn("description", F.lit(None).cast("string")).withColumn("type", F.lit("x"))
    cand = spark.createDataFrame([(i, k, f"C:{k}", f"term {k}", "C", None, "s", 1 - k / 10, 1.0) for i in (1, 2, 3) for k in (1, 2, 3)], "request_id bigint, rank int, code string, term string, ontology string, definition string, source string, normalized_score double, raw_score double")
    rows = decide.prompts(req, cand)
    replies = {1: json.dumps({"selected_code": "C:2", "confidence": 0.9, "alternatives": [{"code": "C:1", "confidence": 0.4}, {"code": "C:3", "confidence": 0.95}, {"code": "nope", "confidence": 0.1}]}), 2: "no json", 3: json.dumps({"selected_code": "X", "confidence": 0.9})}
    answers = spark.createDataFrame([(k, v) for k, v in replies.items()], "request_id bigint, reply string")
    rows = rows.join(answers, "request_id", "left").withColumn("decision", decide.decision(F.col("reply"), F.col("candidates")))
    got = {r.request_id: r for r in decide.results(rows).collect()}
    assert got[1].target_code == "C:2" and [a.code for a in got[1].alternatives] == ["C:1"] and got[1].high_confidence
    assert [got[k].target_code for k in (2, 3, 4)] == [decide.UNMAPPED] * 3
    assert got[3].notes == "code is not a candidate"


class Flaky:
    """Fails for some prompts, always or a number of times, and for batches that hold them."""

    def __init__(self, bad=(), short=(), odd=()):
        self.bad, self.short, self.odd = dict.fromkeys(bad, 99) if not isinstance(bad, dict) else dict(bad), short, odd

    def complete(self, prompts):
        for p in prompts:
            if self.bad.get(p, 0) > 0:
                if len(prompts) == 1:
                    self.bad[p] -= 1
                raise RuntimeError(f"down for {p}, api_key=sk-abcdefghijklmnopqrstuvwxyz0123456789")
        return [7 if p in self.odd else p.upper() for p in prompts if p not in self.short]

    def usage(self, prompts, replies):
        return [(len(p), len(r)) for p, r in zip(prompts, replies, strict=True)]


def test_one_failing_prompt_is_one_failed_row(spark):
    slept = []
    got = providers.asked(Flaky(bad=["p9"], short=["p20"], odd=["p40"]), [f"p{k}" for k in range(64)], sleep=slept.append)
    assert [k for k, x in enumerate(got) if x.error] == [9, 20, 40] and slept == [2.0, 4.0, 8.0] * 3
    assert got[8].reply == "P8" and got[8].tokens == (2, 2) and got[9].attempts == 4 + 6 and got[9].reply is None
    assert "0 replies to 1" in got[20].error and "int" in got[40].error
    healed = providers.asked(Flaky(bad={"a": 2}), ["a"], sleep=slept.append)[0]
    assert (healed.reply, healed.error, healed.attempts) == ("A", None, 3)
    df = spark.createDataFrame([(k, f"p{k}", 1) for k in range(300)], "id int, prompt string, `a.b` int").coalesce(2)
    rows = providers.answered(df, Flaky(bad=["p9"]), batch=16, waits=(0.0,)).select("id", "answer.*").collect()
    assert [r.id for r in rows if r.error] == [9] and len(rows) == 300
    bad = next(r for r in rows if r.error)
    assert bad.error.startswith("RuntimeError: down for p9") and "sk-abc" not in bad.error and bad.attempts == 2 + 4 and bad.input_tokens is None
    assert providers.answered(df.limit(0), Flaky()).count() == 0


class Usageless(Flaky):
    def usage(self, prompts, replies):
        raise RuntimeError("no usage")


def test_usage_that_fails_loses_no_reply(spark):
    got = providers.asked(Usageless(), ["a", "b"])
    assert [(x.reply, x.tokens) for x in got] == [("A", (None, None)), ("B", (None, None))]
    calls = []
    with pytest.raises(RuntimeError):
        providers.Retrying(Flaky(bad=["p"]), sleep=calls.append).complete(["p"])
    assert calls == [2.0, 4.0]


class Canned:
    def __init__(self, by_term):
        self.by_term = by_term

    def complete(self, prompts):
        return [self.by_term[p.split("\n")[0].removeprefix("Term: ")] for p in prompts]


def test_disabled_mode_holds_replies_against_the_request(spark):
    reply = lambda **more: json.dumps({"target_code": "HP:1", "target_term": "x", "ontology": "HP", "confidence": 0.9} | more)
    alternatives = [
        {"code": "HP:2", "term": "a", "ontology": "hpo", "confidence": 0.3}, {"code": "2", "term": "again", "ontology": "HP", "confidence": 0.2}, {"code": "HPO:1", "term": "selected", "ontology": "HPO", "confidence": 0.1},
        {"code": "HP:3", "term": "surer", "ontology": "HP", "confidence": 0.95}, {"code": "LOINC:1-1", "term": "outside", "ontology": "LOINC", "confidence": 0.1}, {"code": "MONDO:4", "term": "contradicts", "ontology": "HP", "confidence": 0.1},
        "junk", {"code": "HP:5", "term": "b", "ontology": "HP", "confidence": "0.5"}, {"code": "HP:6", "term": "no confidence", "ontology": "HP"},
    ]
    cases = {
        "fenced": ("```json\n" + reply(alternatives=alternatives) + "\n```", "HPO", None), "sure": (reply(confidence=7.5), None, None), "other": (reply(target_code="LOINC:1", ontology="LOINC"), "HPO", None),
        "alias": (reply(target_code="5", ontology="rxcui"), "RxNorm", ["rxnorm"]), "outside": (reply(notes="n"), None, ["LOINC"]), "none": (reply(target_code="UNKNOWN:UNMAPPED", alternatives=alternatives), "HPO", None),
        "text": ("no json", None, None), "list": ("[1]", None, None), "words": (reply(confidence="high"), None, []), "contradicts": (reply(target_code="MONDO:1"), None, None),
    }
    df = spark.createDataFrame([(k, t, None, target, allowed) for k, (t, (_, target, allowed)) in enumerate(cases.items())], "request_id bigint, term string, label string, target string, allowed array<string>")
    rows = disabled.mapped(df, Canned({t: r for t, (r, _, _) in cases.items()})).collect()
    got = {list(cases)[r.request_id]: r for r in rows}
    assert {t: r.status for t, r in got.items()} == {"fenced": "mapped", "sure": "error", "other": "error", "alias": "mapped", "outside": "unmapped", "none": "unmapped", "text": "error", "list": "error", "words": "mapped", "contradicts": "error"}
    assert [(a.code, a.confidence) for a in got["fenced"].alternatives] == [("HP:5", 0.5), ("HP:2", 0.3)]
    assert got["alias"].target_code == "RXNORM:5" and got["words"].confidence == 0.0 and got["none"].alternatives == []
    assert got["outside"].notes == disabled.OUTSIDE + " n" and got["outside"].target_code == disabled.CODE and not any(r.is_grounded for r in rows)
    few = disabled.mapped(df.where("term = 'fenced'"), Canned({"fenced": cases["fenced"][0]}), most=1).first()
    assert [a.code for a in few.alternatives] == ["HP:2"]  # cut in the reply's order, then sorted
    shown = disabled.prompts(df, 0).where("term IN ('alias', 'outside')").orderBy("request_id").collect()
    assert "this vocabulary only: RxNorm" in shown[0].prompt and "one of these vocabularies only: LOINC" in shown[1].prompt and "no alternatives" in shown[0].prompt


def test_p_values_beside_math(spark):
    zs = [0.0, 1e-9, 0.5, -1.96, 2.8, 2.9, 5.0, -12.0, 37.0]
    for z, p in zip(zs, one(spark, *[statistics.p_value(F.lit(z)) for z in zs]), strict=True):
        want = math.erfc(abs(z) / math.sqrt(2))
        assert abs(p - want) <= 1e-9 * want + 1e-300, z
    assert one(spark, statistics.p_value(F.lit(None)), statistics.mcnemar(F.lit(None), F.lit(1))) == (None, None)
    pairs = [(0, 0), (1, 9), (5, 5), (0, 1), (0, 1000), (3, 1020), (400, 600), (12, 40), (50_000, 50_600)]

    def exact(b, c):
        n, k = b + c, min(b, c)
        return min(1.0, float(2 * sum(Fraction(math.comb(n, i), 1) for i in range(k + 1)) / Fraction(2) ** n)) if n < 2000 else None

    for (b, c), p in zip(pairs, one(spark, *[statistics.mcnemar(F.lit(b), F.lit(c)) for b, c in pairs]), strict=True):
        want = exact(b, c)
        assert 0 < p < 0.2 if want is None else abs(p - want) <= 1e-9 * want, (b, c, p, want)


def test_validation_by_any_spelling(spark):
    rows = spark.createDataFrame([(c, "mapped") for c in ("HPO:1", "hp_1", "RXCUI:5", "HP:2", "x")], "mapped_code string, status string")
    vocabulary = spark.createDataFrame([("HP:1",), ("RXNORM:5",)], "code string")
    assert {r.mapped_code: r.validation_status for r in validate.validated(rows, vocabulary).collect()} == {"HPO:1": "VALID", "hp_1": "VALID", "RXCUI:5": "VALID", "HP:2": "INVALID", "x": "INVALID"}


def test_merge_and_error_limit(spark):
    rows = spark.createDataFrame([(1, None), (1, "e"), (2, "e"), (2, "e"), (2, None)], "request_id int, error string")
    assert [r.request_id for r in candidates.within_error_limit(rows).collect()] == [1]


def test_runs_and_comparison(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    again = spark.createDataFrame([(2, "c"), (2, "d")], "id int, v string")
    with pytest.raises(Exception, match="twice"):
        runs.patched(base, again, "id", ["v"]).collect()
    assert runs.strays(base, spark.createDataFrame([(9, "x")], "id int, v string"), "id").count() == 1
    assert sorted(tuple(r) for r in compare.mismatches(base, again.limit(1), "id", ["v"]).collect()) == [(1, "missing right"), (2, "differs")]


def test_scores_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, ranks array<string>, gold array<string>, status string")
    assert tuple(score.summed(score.scored(empty)).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    assert score.fractions(empty).first().f1 == 0.0
