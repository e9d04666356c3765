"""Scalar functions on ids, versions, names and URLs. Columns in, columns out; no UDFs."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """The group of the first match, or null where nothing matched."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def unpadded(c: Column) -> Column:
    """ASCII digits without leading zeros; anything else as it is."""
    return F.when(c.rlike("^[0-9]+$"), F.regexp_replace(c, "^0+(?=[0-9])", "")).otherwise(c)


def control_id(raw: Column) -> Column:
    """FAM-n or FAM-n(m) of the first control id in raw, upper case, no leading zeros; null without one."""
    pattern = r"\b([A-Za-z]{2})-([0-9]+)(?:\s*\(([0-9]+)\))?"
    base = F.concat(F.upper(group(raw, pattern)), F.lit("-"), unpadded(group(raw, pattern, 2)))
    more = group(raw, pattern, 3)
    return F.when(more.isNull(), base).otherwise(F.concat(base, F.lit("("), unpadded(more), F.lit(")")))


def catalog_control_id(raw: Column) -> Column:
    """ac-2.1 as AC-2(1); null unless the whole text is such an id."""
    pattern = r"^([a-z]{2})-([0-9]+)(?:\.([0-9]+))?$"
    base = F.concat(F.upper(group(raw, pattern)), F.lit("-"), unpadded(group(raw, pattern, 2)))
    more = group(raw, pattern, 3)
    return F.when(more.isNull(), base).otherwise(F.concat(base, F.lit("("), unpadded(more), F.lit(")")))


def base_control(control: Column) -> Column:
    """AC-2 of AC-2(1): what an enhancement rolls up to, by its id alone."""
    return F.substring_index(control, "(", 1)


def enhancement_number(control: Column) -> Column:
    return F.coalesce(group(control, r"\(([0-9]+)\)").cast("int"), F.lit(0))


def severity_cat(level: Column) -> Column:
    """high, medium, low as I, II, III; anything else as III."""
    known = F.lower(F.trim(level))
    return F.when(known == "high", "I").when(known == "medium", "II").otherwise("III")


def is_known_level(level: Column) -> Column:
    return F.coalesce(F.lower(F.trim(level)).isin("high", "medium", "low"), F.lit(False))


def severity_rank(cat: Column) -> Column:
    return F.when(cat == "I", 1).when(cat == "II", 2).otherwise(3)


def major(version: Column) -> Column:
    return F.coalesce(F.trim(version).try_cast("int"), F.lit(0))


def release_number(info: Column) -> Column:
    """n of 'Release: n', or 0."""
    return F.coalesce(group(info, r"Release:\s*([0-9]+)").try_cast("int"), F.lit(0))


def release_label(version: Column, info: Column) -> Column:
    """V{version}R{n} where both can be read, else the release text as it is."""
    number = group(info, r"Release:\s*([0-9]+)")
    readable = version.rlike(r"^\s*[+-]?[0-9]+\s*$") & number.isNotNull()
    return F.when(readable, F.concat(F.lit("V"), F.trim(version), F.lit("R"), unpadded(number))).otherwise(info)


def keywords(title: Column, key: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.translate(F.coalesce(key, F.lit("")), "_-", "  ")))


def _word(word: str) -> str:
    return rf"(?i)(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)"


def document_kind(status: Column, key: Column, title: Column) -> Column:
    """draft, srg, stig or neither, the first that fits, from the document's own status, id and title."""
    both = F.concat(F.coalesce(key, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))
    bare = F.concat(F.regexp_replace(F.coalesce(key, F.lit("")), r"^xccdf_mil\.disa\.stig_benchmark_", ""), F.lit(" "), F.coalesce(title, F.lit("")))
    draft = F.lower(F.trim(F.coalesce(status, F.lit("")))) == "draft"
    srg = both.rlike("(?i)security requirements guide") | both.rlike(_word("srg"))
    stig = bare.rlike(r"(?i)secur\w* technical implem\w*ation guide") | bare.rlike(_word("stig"))
    return F.when(draft, "draft").when(srg, "srg").when(stig, "stig").otherwise("neither")


# Marks in published archive names.
ADVERSARIAL_MARKS = ["_scap_", "_ansible", "_chef", "_powershell_dsc", "_srg", "_policy_package", "_gpo"]
COMPILATION_MARKS = ["srg-stig", "compilation"]


def archive_tier(name: Column) -> Column:
    """benchmark, adversarial, compilation or junk by name; null for what isn't a zip; an error for names that start with cui_."""
    low = F.lower(name)

    def holds(marks: list[str]) -> Column:
        return F.coalesce(*[F.when(F.contains(low, F.lit(m)), True) for m in marks], F.lit(False))

    barred = F.raise_error(F.concat(F.lit("controlled content is out of scope: "), name)).cast("string")
    return (
        F.when(low.startswith("cui_"), barred)
        .when(~low.endswith(".zip"), F.lit(None).cast("string"))
        .when(~low.startswith("u_") | low.startswith("u_stigviewer-"), "junk")
        .when(holds(COMPILATION_MARKS), "compilation")
        .when(holds(ADVERSARIAL_MARKS), "adversarial")
        .when(F.contains(low, F.lit("_stig")), "benchmark")
        .otherwise("adversarial")
    )


def is_sunset(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("sunset_compilation"))


MONTHS = [calendar.month_name[m].lower() for m in range(1, 13)]


def library_order(name: Column) -> Column:
    """struct(year, month) of a library's name, by month word or number; (0, 0) if it says nothing."""
    word = r"(?i)_Library_([A-Za-z]+)_([0-9]{4})\.zip$"
    number = r"(?i)_Library_([0-9]{4})_([0-9]{2})"
    month = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(group(name, word))), F.lit(0)).cast("int")
    by_word = F.struct(group(name, word, 2).cast("int").alias("year"), month.alias("month"))
    by_number = F.struct(group(name, number).cast("int").alias("year"), group(name, number, 2).cast("int").alias("month"))
    none = F.struct(F.lit(0).alias("year"), F.lit(0).alias("month"))
    return F.when(name.rlike(word), by_word).when(name.rlike(number), by_number).otherwise(none)


_RELEASE = r"(?i)_(?:V([0-9]+)R([0-9]+)|Y([0-9]{2})M([0-9]{2}))_STIG\.zip$"


def release_of(name: Column) -> Column:
    """struct(product, scheme, a, b) of a versioned archive name, null for others. VR and YM releases don't compare."""
    vr = group(name, _RELEASE, 1).isNotNull()
    made = F.struct(
        F.regexp_replace(name, _RELEASE, "").alias("product"),
        F.when(vr, "VR").otherwise("YM").alias("scheme"),
        F.coalesce(group(name, _RELEASE, 1), group(name, _RELEASE, 3)).cast("int").alias("a"),
        F.coalesce(group(name, _RELEASE, 2), group(name, _RELEASE, 4)).cast("int").alias("b"),
    )
    return F.when(name.rlike(_RELEASE), made)


def version_pair(text: Column) -> Column:
    """struct(major, minor) of a strict MAJOR.MINOR, else null."""
    return F.when(text.rlike(r"\A[0-9]+\.[0-9]+\z"), F.struct(F.split(text, r"\.")[0].cast("int").alias("major"), F.split(text, r"\.")[1].cast("int").alias("minor")))


def dotted(version: Column) -> Column:
    """Dotted numbers as an array, which compares componentwise; null for anything else."""
    return F.when(version.rlike(r"\A[0-9]+(?:\.[0-9]+)*\z"), F.transform(F.split(version, r"\."), lambda x: x.cast("int")))


def date_part(value: Column) -> Column:
    return F.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(value, 1, 10))


def git_blob_sha(content: Column) -> Column:
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def file_digest(content: Column) -> Column:
    return F.struct(F.sha2(content, 256).alias("sha256"), F.length(content).cast("long").alias("size"))


def is_bare_name(name: Column) -> Column:
    return name.rlike(r"\A[^/\\:\x00]+\z") & ~name.isin(".", "..")


def is_url_under(url: Column, base: str) -> Column:
    """Whether the url as given begins with base, which is https, and its path beyond, unquoted, takes no step to a parent."""
    beyond = F.try_url_decode(F.replace(F.substring(url, len(base) + 1, 1 << 20), F.lit("+"), F.lit("%2B")))
    return F.coalesce(url.startswith(base) & F.lit(base.startswith("https://")) & ~beyond.rlike(r"(?:^|/)\.\.(?:/|$)"), F.lit(False))


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\Ahttps://[^/\s]+"), F.lit(False))


def benchmark_key(key: Column, version: Column) -> Column:
    return F.concat_ws("/", key, version)


def source_file(origin: Column, artifact: Column, member: Column) -> Column:
    """The file that a benchmark came from: the member's basename for a compilation's, else the artifact's."""
    path = F.when(origin == "library", F.coalesce(member, artifact)).otherwise(artifact)
    return F.element_at(F.split(path, "/"), -1)


def sort_key(version: Column) -> Column:
    """An orderable struct: dotted numbers by value of each part, then the text; others last."""
    parts = F.transform(F.split(version, r"\."), lambda x: F.struct(F.length(F.ltrim(x, F.lit("0"))).alias("n"), F.ltrim(x, F.lit("0")).alias("digits")))
    numeric = version.rlike(r"\A[0-9]+(?:\.[0-9]+)*\z")
    return F.struct(F.when(numeric, 0).otherwise(1).alias("kind"), F.when(numeric, parts).otherwise(F.array().cast("array<struct<n:int,digits:string>>")).alias("parts"), version.alias("text"))


def sorted_versions(versions: Column) -> Column:
    return F.transform(F.array_sort(F.transform(versions, sort_key)), lambda k: k["text"])


def mapping_version(version: Column, framework: Column, attack: Column, updated: Column) -> Column:
    """The mapping's own version, else one put together from what the metadata names, '?' for what it doesn't."""

    def named(c: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("?"))

    return F.coalesce(F.nullif(F.trim(version), F.lit("")), F.format_string("%s/ATT&CK %s/%s", named(framework), named(attack), named(updated)))


def holds_barred_part(path: Column) -> Column:
    """Whether any part of a path starts with cui_, in either separator."""
    return F.exists(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.lower(p).startswith("cui_"))


def capped(items: Column, most: int = 4) -> Column:
    """'a, b, c, d, and N more'."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) > most, F.concat(shown, F.lit(", and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise(shown)
