"""PII: base patterns, and bootstrapped contextual extraction that learns from them, all in DataFrame functions.

Base entities are seeds. The two words to the left of a seed are a lexical pattern, whatever they hold: an identifier among them is a
placeholder, and so is the text's start. Patterns and the identifier-like tokens that they
precede make a graph; scores go back and forth over it (a pattern's is the mean of its instances', an instance's the best of its
patterns'), and identifier-like tokens behind a pattern of high confidence are entities too, of the kind that the pattern mostly precedes.
These are instances in their turn and may raise other patterns to high confidence, until no new one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import lookup, stored

KINDS = ("email", "ip", "card", "phone")
#: Seeds with different values that a pattern needs, its least score, and the rounds of scoring. DOUBT counts as so many wrong instances.
SUPPORT, CONFIDENT, ROUNDS, DOUBT = 4, 0.75, 3, 1.0
#: Digits and characters of a token that looks like an identifier, at least (or an @ within).
DIGITS, LENGTH = 4, 6

# Possessive and anchored where that changes no match: no quadratic search and no deep recursion on long texts.
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # The whole chain of digits, which has 16 to 19: longer and shorter chains fail anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_INK, _END = r"[^\x20\x09-\x0D]", r"(?![^\x20\x09-\x0D])"
# Digit groups one space apart, one of each two neighbours under LENGTH characters, are one token. Dotted quads stay alone.
_GROUP = r"(?![0-9]++(?:\.[0-9]++){3}(?![0-9.]))\(?[0-9][0-9()./-]*+[^\p{L}\p{N}@+\x20\x09-\x0D]*+" + _END
_JOINT = rf"(?<=[0-9)])(?:(?<=(?<!{_INK}){_INK}{{1,{LENGTH - 1}}})[\x20\x09]|[\x20\x09](?={_INK}{{1,{LENGTH - 1}}}{_END}))"
_TOKEN = rf"(?<!{_INK})(?=[^\x20\x09-\x0D0-9@]*+[0-9@])(?:(?:\+?{_GROUP}|[A-Z]{{1,3}}[0-9]{{1,4}}(?=[\x20\x09][0-9(]))(?:{_JOINT}{_GROUP})*+|{_INK}++)"
#: Placeholders in a cue: the text's start, an identifier.
START, NAMED = "^", "<id>"


def _chunks(array: str) -> Column:
    """A column's array in runs of about the square root of its size, so that what is done run by run takes no square of the size."""
    step = f"greatest(8, cast(ceil(sqrt(size({array}))) as int))"
    return F.expr(f"transform(if(size({array}) > 0, sequence(1, size({array}), {step}), cast(array() as array<int>)), k -> slice({array}, k, {step}))")


def _scan(df: DataFrame, numbers: dict[str, Column], merge: str) -> DataFrame:
    """df with columns of the given names: for each number of an array of int the merge (an expression of acc and v) of all before it, from 0.

    Step by step in columns of their own: what is read for each element must not be made again for each."""

    def grown(over: str, zero: str) -> str:
        start = f"named_struct('at', {zero}, 'found', cast(array() as array<int>))"
        return f"aggregate({over}, {start}, (s, v) -> named_struct('at', {merge.replace('acc', 's.at')}, 'found', array_append(s.found, s.at)), s -> s.found)"

    df = df.withColumns({f"_n_{c}": n for c, n in numbers.items()})
    df = df.withColumns({f"_c_{c}": _chunks(f"_n_{c}") for c in numbers})
    df = df.withColumns({f"_t_{c}": F.expr(f"transform(_c_{c}, c -> aggregate(c, 0, (acc, v) -> {merge}))") for c in numbers})
    df = df.withColumns({f"_b_{c}": F.expr(grown(f"_t_{c}", "0")) for c in numbers})
    df = df.withColumns({c: F.expr(f"flatten(zip_with(_c_{c}, _b_{c}, (c, before) -> {grown('c', 'before')}))") for c in numbers})
    return df.drop(*[f"_{x}_{c}" for x in "nctb" for c in numbers])


def _placed(pairs: str, before: str) -> Column:
    """Array of (start, end, hit) of the matches in a column made by _pairs(); before: the length of all that precedes each pair."""
    return F.expr(f"filter(zip_with({pairs}, {before}, (x, at) -> named_struct('start', at + length(x.before), 'end', at + length(x.before) + length(x.hit), 'hit', x.hit)), x -> x.hit is not null)")


def _pairs(text: Column, pattern: str) -> Column:
    """Array of (before, hit) of the pattern's matches; before: what stands between this match and the last."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, h: F.struct(b.alias("before"), h.alias("hit")))


def _last_words(text: Column) -> Column:
    """The last two words, or the only one."""
    return F.regexp_extract(text, rf"(?<!{_INK})(?:{_INK}++[\x20\x09-\x0D]++)?+{_INK}++[\x20\x09-\x0D]*+$|(?<!{_INK}){_INK}++[\x20\x09-\x0D]*+$", 0)


def _cues(pairs: str) -> Column:
    """The cue of each match in a column made by _pairs(): the two words before it, lower case, digits as 0, placeholders for identifiers and
    the text's start. Long ones by their hash. Each token is a word at least, so the two before and what stands between tell it."""

    def word(k: Column) -> Column:
        hit = F.get(pairs, k)["hit"]
        return F.when(k < -1, "").when(k == -1, START + " ").otherwise(F.when(_like(hit) | F.contains(hit, F.lit("@")), NAMED).otherwise(hit))

    def cue(x: Column, k: Column) -> Column:
        between = F.when(k > 0, F.get(pairs, k - 1)["before"]).otherwise("")
        words = F.rtrim(_last_words(F.concat(word(k - 2), between, word(k - 1), x["before"])))
        cue = F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")
        return F.when(F.length(cue) > 80, F.md5(cue)).otherwise(cue)

    return F.transform(pairs, cue)


def _like(hit: Column) -> Column:
    """Whether a token looks like an identifier."""
    return (F.length(hit) >= LENGTH) & ((F.length(_digits(hit)) >= DIGITS) | F.contains(hit, F.lit("@"))) | hit.startswith("+")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Every second digit from the right but the first counts double, less 9 if over 9; the sum must end in 0."""
    backwards = F.transform(F.split(F.reverse(_digits(hit)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(backwards, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, text_key, the base spans of each kind, and the tokens that hold a base span's
    start or look like an identifier, with their cues. The work grows with the text's matches to the power of 1.5 at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).withColumn("numeric", F.col("text").rlike("[0-9]"))
    no_pairs = F.array().cast("array<struct<before:string,hit:string>>")

    def may(kind: str) -> Column:
        hint = (F.instr("text", _HINT[kind]) > 0) if _HINT[kind] else F.lit(True)
        return hint if kind == "email" else F.col("numeric") & hint

    def valid(kind: str):
        return lambda x: _holds(kind, x["hit"])

    pairs = {f"_{k}": F.when(may(k), _pairs(F.col("text"), PATTERNS[k])).otherwise(no_pairs) for k in KINDS}
    rows = rows.withColumns(pairs | {"_token": F.when(F.col("numeric") | (F.instr("text", "@") > 0), _pairs(F.col("text"), _TOKEN)).otherwise(no_pairs)}).drop("text", "numeric")
    rows = _scan(rows, {f"_before{c}": F.expr(f"transform({c}, x -> length(x.before) + coalesce(length(x.hit), 0))") for c in (*pairs, "_token")}, "acc + v")
    rows = rows.withColumns({k: F.filter(_placed(f"_{k}", f"_before_{k}"), valid(k)) for k in KINDS} | {"_at": _placed("_token", "_before_token"), "_cue": _cues("_token")})
    rows = rows.select("doc_id", "text_key", *KINDS, "_at", "_cue")

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.xxhash64(s["hit"]).alias("value")))

    rows = rows.withColumn("_sorted", F.array_sort(F.flatten(F.array(*[named(k) for k in KINDS]))))
    spans = F.transform(_chunks("_sorted"), lambda c: F.struct(c[0]["start"].alias("low"), F.array_max(F.transform(c, lambda s: s["end"])).alias("high"), c.alias("spans")))
    rows = rows.withColumn("_spans", spans)

    def token(x: Column, cue: Column) -> Column:
        near = F.filter("_spans", lambda c: (c["low"] < x["end"]) & (c["high"] > x["start"]))
        inside = F.flatten(F.transform(near, lambda c: F.filter(c["spans"], lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))))
        first = F.get(F.filter(inside, lambda s: s["start"] >= x["start"]), 0)
        lead = F.length(F.regexp_extract(x["hit"], r"^[^\p{L}\p{N}]*", 0))
        tail = F.length(F.regexp_extract(x["hit"], r"[^\p{L}\p{N}]*$", 0))
        kind = F.when(F.size(inside) == 0, F.when(_like(x["hit"]), F.lit(""))).otherwise(first["kind"])  # null: it goes on in a span that began before
        value = F.coalesce(first["value"], F.xxhash64(F.substring(x["hit"], lead + 1, F.length(x["hit"]) - lead - tail)))
        return F.struct((x["start"] + lead).alias("start"), (x["end"] - tail).alias("end"), kind.alias("kind"), value.alias("value"), cue.alias("cue"))

    found = F.filter(F.zip_with("_at", F.slice("_cue", F.lit(1), F.size("_at")), token), lambda t: t["kind"].isNotNull() & (t["end"] > t["start"]))
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    return rows.select("doc_id", "text_key", *bare, found.alias("tokens"))


def confident_patterns(tokens: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """(cue, kind, score) of the patterns to trust. tokens: cue, value and kind ('' where no base pattern matched).

    A generation scores every cue that precedes an instance found so far, in rounds over the graph of these cues, and trusts those with
    enough instances found and a high score; what stands behind them is found for the next generation, with its score. The last generation
    is the first that trusts no new cue.
    """
    edges = stored(tokens.groupBy("cue", "value").agg(F.max("kind").alias("kind")), "edges")
    pairs = edges.select("cue", "value")
    seeds = edges.filter("kind <> ''").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = found = stored(seeds, "instances")
    trusted = None
    while True:
        kinds = lookup(pairs, "value", found, "cue").groupBy("cue", "kind").agg(F.count("*").alias("n"))
        cues = stored(kinds.groupBy("cue").agg(F.sum("n").alias("found"), F.max_by("kind", F.struct("n", "kind")).alias("kind")), "cues")
        graph = stored(lookup(pairs, "cue", cues.select("cue"), "value"), "graph")
        scores = found.select("value", "score")
        for k in range(rounds):
            weighed = lookup(graph, "value", scores, "cue", "left")
            pattern = F.round(F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("*") + F.lit(DOUBT)), 12)
            by_cue = stored(weighed.groupBy("cue").agg(pattern.alias("pattern")), "patterns")
            if k < rounds - 1:
                best = lookup(graph, "cue", by_cue, "value").select("value", F.col("pattern").alias("score")).unionByName(found.select("value", "score"))
                scores = stored(best.groupBy("value").agg(F.max("score").alias("score")), "instances")
        new = by_cue.filter(F.col("pattern") >= confident).join(cues.filter(F.col("found") >= support), "cue").select("cue", "kind", F.col("pattern").alias("score"))
        new = stored(new.join(trusted, "cue", "left_anti") if trusted else new, "trusted")
        if new.isEmpty():
            return trusted or new
        trusted = stored(trusted.unionByName(new), "trusted") if trusted else new
        behind = lookup(pairs, "cue", trusted, "value").select("value", "kind", "score").unionByName(seeds.select("value", "kind", "score"))
        found = stored(behind.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")), "instances")


def detected(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_key, spans (array of kind, start, end; kinds in the order of KINDS, then by start), base_spans (likewise, base ones alone).

    Offsets are code points, ends exclusive. A null text counts as an empty one. Rows alike in doc_id and text get the same spans; a null
    doc_id is kept. No pattern is learnt from an empty table. Columns but doc_id and text aren't looked at.
    """
    rows = stored(scanned(docs), "scanned")
    tokens = rows.select("doc_id", "text_key", F.explode("tokens").alias("t")).select("doc_id", "text_key", "t.*")
    trusted = confident_patterns(tokens.select("cue", "value", "kind"), **how)
    new = lookup(tokens.filter("kind = ''").drop("kind"), "cue", trusted, "start")
    added = new.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    joined = rows.join(added, F.expr("doc_id <=> _doc and text_key = _key"), "left").select("doc_id", "text_key", *KINDS, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))

    def spans(kind: str, more: bool) -> Column:
        base = F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.array_sort(F.concat(base, F.filter("added", lambda s: s["kind"] == kind))) if more else base

    return joined.select("doc_id", "text_key", F.flatten(F.array(*[spans(k, True) for k in KINDS])).alias("spans"), F.flatten(F.array(*[spans(k, False) for k in KINDS])).alias("base_spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (all spans), base_sha256, spans."""

    def written(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redacted(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with every span of the text replaced by its kind in angle brackets; the first of overlapping spans names them."""
    found = detected(docs, **how).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    sorted_spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.select("doc_id", "text_key", sorted_spans.alias("spans"))
    found = _scan(found, {"ends": F.expr("transform(spans, s -> s.end)")}, "greatest(acc, v)")
    # Where a span begins in none before it: the text kept before it begins at the last end.
    heads = F.filter(F.zip_with("spans", "ends", lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda s: s["start"] >= s["at"])
    found = found.withColumn("heads", heads).select("doc_id", "text_key", _chunks("heads").alias("heads"), F.array_max(F.transform("spans", lambda s: s["end"])).alias("last"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).join(found, F.expr("d.doc_id <=> doc_id and xxhash64(coalesce(d.text, '')) = text_key"), "left")

    def clean(chunk: Column) -> Column:
        low, last = chunk[0]["at"], F.element_at(chunk, -1)["start"]
        region = F.transform(F.array(F.substring(F.col("d.text"), low + 1, last - low)), lambda r: F.array_join(F.transform(chunk, lambda s: F.concat(F.substring(r, s["at"] - low + 1, s["start"] - s["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))), ""))
        return region[0]

    text = F.concat(F.array_join(F.transform("heads", clean), ""), F.substring(F.col("d.text"), F.col("last") + 1, F.lit(2_147_483_647)))
    return rows.select(F.col("d").withField("text", F.when(F.col("heads").isNull(), F.col("d.text")).otherwise(text)).alias("d")).select("d.*")
