"""Small fixed dimensions: vocabulary aliases, code prefixes, retrieval routes, rank scores. All are of constant size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of vocabularies and the key that each stands for.
ALIASES = {
    "HPO": "HPO", "HP": "HPO", "SCTID": "SNOMED-CT", "SNOMED": "SNOMED-CT", "SNOMEDCT": "SNOMED-CT", "SNOMED-CT": "SNOMED-CT",
    "LOINC": "LOINC", "MONDO": "MONDO", "NCIT": "NCIT", "RXNORM": "RxNorm", "RXCUI": "RxNorm", "ICD10": "ICD10", "ICD10CM": "ICD10",
    "UO": "UO", "UBERON": "UBERON", "CHEBI": "CHEBI", "EFO": "EFO",
}
# The prefix of a vocabulary's codes, where it isn't the vocabulary's key.
PREFIXES = {"HPO": "HP", "SNOMED-CT": "SNOMEDCT", "RxNorm": "RXNORM"}
# Which source serves a vocabulary, the source's own name for it, and more spellings that only routing knows.
ROUTES = {
    "HPO": ("ols4", None, []), "MONDO": ("ols4", None, []), "NCIT": ("ols4", None, []), "LOINC": ("loinc", None, []), "UO": ("ols4", None, []),
    "ICD10": ("nih_clinical_tables", None, ["ICD", "ICD-10", "ICD-10-CM"]), "SNOMED-CT": ("ols4", "SNOMED", ["SNOMED", "SNOMEDCT"]),
    "RxNorm": ("rxnav", None, ["RXNORM", "RXNAV", "RXCUI"]), "EFO": ("ols4", None, []), "UBERON": ("ols4", None, []), "CHEBI": ("ols4", None, []),
    "GO": ("ols4", None, []), "DOID": ("ols4", None, []), "MESH": ("ols4", None, []),
}
# Vocabularies recommended for a kind of entity, the first one preferred.
ENTITY_VOCABULARIES = {
    "phenotype": ["HPO"], "comorbidity": ["MONDO", "ICD10"], "medication": ["RxNorm", "NCIT"], "procedure": ["SNOMED-CT", "NCIT"], "measurement": ["LOINC"],
    "exposure": ["SNOMED-CT"], "specimen": ["NCIT"], "sample": ["NCIT", "SO"], "default": ["HPO", "MONDO", "NCIT"],
}
#: Ranks that are scored.
MAX_RANK = 5


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)
