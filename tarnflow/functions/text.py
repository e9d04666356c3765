"""Tokens, versions and scores of texts, in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.ids import unpadded

# Acronyms that spell out, tokens that say nothing, heads of role phrases, a version glued to a letter.
SYNONYMS = {
    "redhat": "red hat",
    "rhel": "red hat enterprise linux",
    "win": "windows",
    "ms": "microsoft",
    "iis": "internet information services",
    "hpe": "hewlett packard enterprise",
    "ws1": "workspace one",
    "kpe": "knox platform for enterprise",
    "asa": "adaptive security appliance",
    "aci": "application centric infrastructure",
    "sel": "schweitzer engineering laboratories",
    "ise": "identity services engine",
    "racf": "resource access control facility",
    "tss": "top secret service",
    "epmm": "endpoint manager mobile",
    "mdb": "mongodb",
    "sol": "solaris",
    "sym": "symantec",
    "ntx": "nutanix",
    "pgsql": "postgres",
    "asd": "application development",
}
STOP_TOKENS = ["security", "technical", "implementation", "guide", "stig", "srg", "benchmark", "manual"]
PHRASE_HEADS = ["layer", "tier", "level", "phase", "type", "zone", "class"]
GLUED = {"19c": "19"}

EXPANSIONS = {k: [t for t in v.split() if t not in STOP_TOKENS] for k, v in SYNONYMS.items()}
_VERSION = r"^[0-9]+(?:[.-][0-9]+)*$|^v[0-9]+r[0-9]+$"


def strings(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _map(of: dict[str, list[str]]) -> Column:
    return F.create_map(*[c for k, v in of.items() for c in (F.lit(k), strings(v))])


def expansion_of(token: Column) -> Column:
    """The tokens that a synonym key spells out, stop tokens left out; null for other tokens."""
    return F.try_element_at(_map(EXPANSIONS), token)


def _classified(tokens: Column) -> Column:
    """struct(product, version): sets of the tokens that aren't stop tokens. A number right after a role phrase's head is a product token;
    stop tokens still count as what stands before."""
    marked = F.transform(
        tokens,
        lambda t, k: F.struct(
            t.alias("t"),
            (t.rlike(_VERSION) & ~F.coalesce(F.get(tokens, k - 1).isin(PHRASE_HEADS), F.lit(False))).alias("v"),
        ),
    )
    kept = F.filter(marked, lambda m: ~m["t"].isin(STOP_TOKENS))
    pick = lambda want: F.array_sort(F.array_distinct(F.transform(F.filter(kept, lambda m: m["v"] == F.lit(want)), lambda m: m["t"])))
    return F.struct(pick(False).alias("product"), pick(True).alias("version"))


def normalized(text: Column) -> Column:
    """struct(product, version, expanded) of a text: sorted token sets. Expanded: what only a synonym's expansion brought in."""
    literal = word_tokens(F.coalesce(text, F.lit("")))
    spelt = F.flatten(F.transform(literal, lambda t: F.coalesce(F.try_element_at(_map({k: v.split() for k, v in SYNONYMS.items()}), t), F.array().cast("array<string>"))))
    own, more = _classified(literal), _classified(spelt)
    union = lambda f: F.array_sort(F.array_union(own[f], more[f]))
    new = F.array_except(F.array_union(more["product"], more["version"]), F.array_union(own["product"], own["version"]))
    return F.struct(union("product").alias("product"), union("version").alias("version"), F.array_sort(new).alias("expanded"))


def glued_versions(product: Column) -> Column:
    """Versions that product tokens carry with letters: v9 and what GLUED names."""
    prefixed = F.transform(F.filter(product, lambda t: t.rlike("^v[0-9]+$")), lambda t: F.substring(t, 2, 64))
    named = F.filter(F.transform(product, lambda t: F.try_element_at(F.create_map(*[F.lit(x) for kv in GLUED.items() for x in kv]), t)), lambda v: v.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(prefixed, named)))


def version_runs(text: Column) -> Column:
    """Every version that a text writes, '-' as '.'; not digits inside a word, nor right after a role phrase's head."""
    behind = "".join(f"(?<!{h}[ \\t]{{1,8}})" for h in PHRASE_HEADS)
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9]){behind}v?([0-9]+(?:[.-][0-9]+)*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(runs, lambda r: F.translate(r, "-", "."))))


def version_majors(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("[0-9]+(?:[.-][0-9]+)*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(runs, lambda r: F.split(r, "[.-]")[0])))


def is_subset(some: Column, of: Column) -> Column:
    return F.size(F.array_except(some, of)) == 0


def satisfied(token: Column, document: Column) -> Column:
    """Whether the document holds the token, or all that the token spells out."""
    spelt = expansion_of(token)
    return F.array_contains(document, token) | F.coalesce(is_subset(spelt, document), F.lit(False))


def matched_versions(query: Column, document: Column) -> Column:
    """Query versions that the document holds, as written or without the query's leading zeros."""
    return F.filter(query, lambda v: F.array_contains(document, v) | F.array_contains(document, unpadded(v)))


def covered_versions(written: Column, covered: Column) -> Column:
    """The versions as titles write them that share a part with a covered one; the covered ones if none does."""
    kept = F.filter(written, lambda r: F.exists(F.split(r, r"\."), lambda p: F.array_contains(covered, p)))
    return F.when(F.size(kept) > 0, kept).otherwise(covered)


def like_pattern(term: str) -> str:
    """A caller's term between wildcards, in lower case; its own _ and % are wildcards too."""
    return f"%{term.lower()}%"


def like(c: Column, term: str) -> Column:
    """LIKE without an escape character, as the caller's term is taken as it is."""
    return F.like(F.lower(c), F.lit(like_pattern(term)), F.lit("\x01"))
