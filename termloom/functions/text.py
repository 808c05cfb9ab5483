"""Text expressions: cleaning of model output, fixed explanations, names made readable."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a term's words say about when to use it; the first pattern that fits decides.
USES_FIRST = [
    (r"\b(mean|average|averaged)\b", "Use if the field stores an average across repeated measurements."),
    (r"\b(noninvasive|non-invasive|cuff)\b", "Use if the field indicates noninvasive cuff-based measurement."),
    (r"\b(invasive|arterial line)\b", "Use if the measurement was obtained through invasive arterial monitoring."),
    (r"\b(exercise|stress)\b", "Use if the measurement was taken during exercise or stress testing."),
    (r"\b(aorta|aortic)\b", "Use if the measurement site is specifically the aorta."),
    (r"\b(baseline|pre[- ]?treatment)\b", "Use if the field captures baseline values before treatment or follow-up."),
    (r"\b(first encounter|first visit|initial encounter|initial visit)\b", "Use if the field captures the first clinical encounter."),
    (r"\b(initial)\b", "Use if the field captures the initial measurement."),
    (r"\b(follow[- ]?up|followup)\b", "Use if the field captures a follow-up timepoint."),
]
# Sites and specimens that a term may name, and uses that come last.
SITES = ["pulmonary artery", "radial artery", "femoral artery", "carotid artery", "brachial artery", "left arm", "right arm", "arm", "ankle", "wrist", "leg"]
SPECIMENS = [
    (r"\bcerebrospinal fluid\b|\bcsf\b", "cerebrospinal fluid"), (r"\burine\b", "urine"), (r"\bserum\b", "serum"), (r"\bplasma\b", "plasma"), (r"\bsaliva\b", "saliva"),
    (r"\bsputum\b", "sputum"), (r"\bstool\b|\bfeces\b", "stool"), (r"\btissue\b", "tissue"), (r"\bswab\b", "swab"), (r"\bblood specimen\b|\bwhole blood\b", "blood"),
]
USES_LAST = [(r"\bdiastolic\b", "Use if the field captures diastolic blood pressure."), (r"\bsystolic\b", "Use if the field captures systolic blood pressure.")]
# Fixed value: keys that must not reach a log.
KEYS = r"(sk-[A-Za-z0-9_-]{8,}|Bearer\s+\S+|(?i:api[_-]?key)\s*[=:]\s*\S+)"


def first_match(text: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The value of the first rule whose pattern the text holds."""
    return reduce(lambda out, rule: F.when(text.rlike(rule[0]), F.lit(rule[1])).otherwise(out), reversed(rules), default if default is not None else F.lit(None).cast("string"))


def body_site(lower: Column) -> Column:
    return first_match(lower, [(rf"\b{s}\b", s) for s in SITES])


def specimen(lower: Column) -> Column:
    return first_match(lower, SPECIMENS)


def concise(term: Column, most: int = 8) -> Column:
    words = F.regexp_extract_all(term, F.lit(r"([A-Za-z0-9][A-Za-z0-9:/.-]*)"), F.lit(1))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, most), " ")).otherwise("this candidate concept")


def explanation(term: Column) -> Column:
    """When to use an alternative, by its term alone."""
    term = F.trim(term)
    lower = F.lower(term)
    last = first_match(lower, USES_LAST, F.concat(F.lit("Use only if the field specifically means "), concise(term), F.lit(".")))
    of = F.when(specimen(lower).isNotNull(), F.concat(F.lit("Use if the source field uses a "), specimen(lower), F.lit(" specimen."))).otherwise(last)
    at = F.when(body_site(lower).isNotNull(), F.concat(F.lit("Use if the measurement site is specifically the "), body_site(lower), F.lit("."))).otherwise(of)
    return first_match(lower, USES_FIRST, at)


def without_fences(text: Column) -> Column:
    """A model's reply without the fence of a code block around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def safe_message(text: Column, most: int = 500) -> Column:
    """Keys replaced first, then cut."""
    return F.left(F.regexp_replace(text, KEYS, "***REDACTED***"), F.lit(most))


def bounded(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def readable(name: Column) -> Column:
    """snake_case and camelCase as words."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[_\-]", " "), r"([a-z])([A-Z])", "$1 $2"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def source_text(text: Column) -> Column:
    """Composed Unicode (only text beyond ASCII goes through Python) without white space at its ends."""
    return F.trim(F.coalesce(F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfc(text)), F.lit("")))


def gold_curie(text: Column, ascii_only: bool = False) -> Column:
    """A code with its prefix upper-cased and ORPHANET as ORDO; the local part stays as it is."""
    t = F.trim(F.coalesce(text, F.lit(""))) if ascii_only else source_text(text)
    pattern = r"^([A-Za-z][A-Za-z0-9]*):(.+)$"
    prefix, local = F.upper(F.regexp_extract(t, pattern, 1)), F.trim(F.regexp_extract(t, pattern, 2))
    return F.when(prefix == "", t).otherwise(F.concat(F.when(prefix == "ORPHANET", "ORDO").otherwise(prefix), F.lit(":"), local))
