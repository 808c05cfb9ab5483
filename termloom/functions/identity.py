"""Vocabulary identity as column expressions: aliases, code namespaces, IRIs, and whether they agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import ALIASES, PREFIXES, lookup

CURIE = r"^([A-Za-z][A-Za-z0-9-]*):(.+)$"
SEGMENT = r"^([A-Za-z][A-Za-z0-9-]*)[_:](.+)$"


def blank(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions that use a part several times would otherwise grow with every layer."""
    return F.transform(F.array(value), body)[0]


def canonical(c: Column) -> Column:
    """The vocabulary's key for any of its spellings; upper-cased text for an unknown one; null for a blank."""
    return let(F.upper(blank(c)), lambda u: F.coalesce(lookup(ALIASES, u), u))


def prefix_of(c: Column) -> Column:
    """The prefix of a vocabulary's codes."""
    return let(canonical(c), lambda key: F.coalesce(lookup(PREFIXES, key), F.upper(key), F.lit("")))


def code_prefix(c: Column) -> Column:
    return blank(F.upper(F.regexp_extract(F.replace(F.trim(c), F.lit("_"), F.lit(":")), CURIE, 1)))


def namespace(c: Column) -> Column:
    """The vocabulary that a code's own prefix names; null without a prefix."""
    return canonical(code_prefix(c))


def curie_from_iri(c: Column) -> Column:
    """The code in an IRI's last segment; null if that isn't a prefix and a local part."""
    last = lambda t: F.when(t.contains("/") | t.contains("#"), F.regexp_extract(F.regexp_replace(t, r"[/#]+$", ""), r"[^/#]*$", 0)).otherwise(t)
    return let(let(F.trim(c), last), lambda s: split_code(s, SEGMENT))


def split_code(text: Column, pattern: str) -> Column:
    """A code of the pattern's prefix, in canonical form, and local part; null if text isn't both."""
    return let(F.regexp_extract(text, pattern, 1), lambda p: F.when(p != "", F.concat(prefix_of(p), F.lit(":"), F.trim(F.regexp_extract(text, pattern, 2)))))


def normalized_code(code: Column, ontology: Column) -> Column:
    """A code with its own prefix in canonical form, or with the vocabulary's if it has none. Every `_` counts as `:`."""

    def of(v: Column) -> Column:
        # what a code's own text says comes first; the vocabulary is looked up only for codes without a prefix
        given = let(prefix_of(v.ontology), lambda g: F.when(g != "", F.concat(g, F.lit(":"), v.text)))
        return F.when(v.text == "", v.text).otherwise(F.coalesce(curie_from_iri(v.text), split_code(v.text, CURIE), given, v.text))

    return let(F.struct(F.replace(F.trim(code), F.lit("_"), F.lit(":")).alias("text"), ontology.alias("ontology")), of)


def nested(code: Column) -> Column:
    """Whether a code's local part is itself a code of a known vocabulary."""
    text = F.replace(F.trim(code), F.lit("_"), F.lit(":"))
    inner = F.upper(F.regexp_extract(F.trim(F.regexp_extract(text, CURIE, 2)), CURIE, 1))
    return inner.isin(*sorted({*ALIASES, *PREFIXES.values(), "GO", "DOID", "MESH"}))


def inconsistency(ontology: Column, code: Column, iri: Column) -> Column:
    """Why a candidate's vocabulary, code and IRI don't describe one namespace; null if they do."""
    text = F.coalesce(F.trim(code), F.lit(""))
    parts = F.struct(canonical(ontology).alias("key"), text.alias("text"), namespace(text).alias("by_code"), namespace(curie_from_iri(iri)).alias("by_iri"), code_prefix(text).alias("prefix"), prefix_of(ontology).alias("own"))

    def of(v: Column) -> Column:
        local = F.when(v.by_code.isNotNull(), F.regexp_extract(v.text, r"(?s)^[^:]*:(.*)$", 1)).otherwise(v.text)
        return (
            F.when(v.key.isNull(), "missing ontology")
            .when((v.key == "UNKNOWN") & (F.upper(v.text) == "UNKNOWN:UNMAPPED"), F.lit(None))
            .when(v.text == "", "missing code")
            .when(nested(v.text), "nested code namespace")
            .when(v.by_code.isNotNull() & v.by_iri.isNotNull() & (v.by_code != v.by_iri), "code and IRI disagree")
            .when(v.by_iri.isNotNull() & (v.by_iri != v.key), "IRI and ontology disagree")
            .when(v.key.isin("HPO", "MONDO"), F.when(F.coalesce((v.by_code != v.key) | (v.prefix != v.own), F.lit(True)), "foreign code"))
            .when(v.key == "LOINC", F.when((F.coalesce(v.by_code, F.lit("LOINC")) != "LOINC") | ~local.rlike(r"^\d{1,7}-\d$"), "no valid identifier"))
            .when(v.by_code.isNotNull() & (v.by_code != v.key), "code and ontology disagree")
        )

    return let(parts, of)


def resolved(code: Column, iri: Column, explicit: Column, fallback: Column) -> Column:
    """A struct code, ontology, reason from a candidate's code, IRI, stated and default vocabulary, in that order; null if
    they contradict each other or leave nothing."""
    raw = F.coalesce(F.trim(code), F.lit(""))
    own = let(raw, lambda r: F.coalesce(curie_from_iri(r), F.replace(r, F.lit("_"), F.lit(":"))))
    first = F.struct(raw.alias("raw"), own.alias("own"), curie_from_iri(iri).alias("from_iri"), iri.alias("iri"), canonical(explicit).alias("stated"), canonical(fallback).alias("default"))
    second = lambda v: F.struct(v.raw.alias("raw"), v.own.alias("own"), v.from_iri.alias("from_iri"), v.iri.alias("iri"), v.stated.alias("stated"), namespace(v.own).alias("by_code"), namespace(v.from_iri).alias("by_iri"), v.default.alias("default"))

    def third(v: Column) -> Column:
        key = F.coalesce(v.by_code, v.by_iri, v.stated, v.default)
        reason = F.when(v.by_code.isNotNull(), "code").when(v.from_iri.isNotNull(), "iri").when(v.stated.isNotNull(), "explicit").otherwise("fallback")
        text = F.when(v.by_code.isNotNull(), v.own).when(v.raw != "", v.raw)
        found = F.when(v.by_code.isNull() & v.from_iri.isNotNull(), v.from_iri).otherwise(normalized_code(text, key))
        clash = F.coalesce(v.by_code != v.by_iri, F.lit(False))
        return F.struct(found.alias("code"), key.alias("ontology"), reason.alias("reason"), v.iri.alias("iri"), clash.alias("clash"))

    def fourth(v: Column) -> Column:
        ok = ~v.clash & v.ontology.isNotNull() & v.code.isNotNull() & inconsistency(v.ontology, v.code, v.iri).isNull()
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(v.code.alias("code"), v.ontology.alias("ontology"), v.reason.alias("reason")))

    return let(let(let(first, second), third), fourth)


def eligible(ontology: Column, retrieved_from: Column, targets: Column, *, strict: bool = False) -> Column:
    """Whether a candidate may answer a request for these vocabularies (null: any): it belongs to one, or it was found in
    EFO's search space and EFO is asked for (not if strict)."""
    asked = F.transform(targets, canonical)
    native = F.array_contains(asked, canonical(ontology))
    imported = F.lit(False) if strict else F.array_contains(asked, "EFO") & F.array_contains(F.transform(retrieved_from, canonical), "EFO")
    return F.coalesce(targets.isNull() | native | F.coalesce(imported, F.lit(False)), F.lit(False))
