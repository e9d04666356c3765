"""Documents that claim one id: two that cannot be releases of each other are told apart and renamed, all others contest.

`settled` is the plan: collisions are found within (id, version, artifact, release), one row a group of documents says whether it can be split,
and what is folded in order is these rows alone, by families of ids that corrections tie together; the contests are scanned by ranges. `replayed`
tells the same story event by event, document after document, and shares nothing with the plan but the columns and how they are read;
`disagreements` holds one against the other. Neither keeps a group's documents in a task's memory: rows come in order, and are let go.

Columns of documents: stig_id, version, arrival (a string or number, one for each document, that orders them), artifact, release, is_library,
status_date, path, rules (array of strings). Corrections: stig_id -> [(part of a path, corrected id)].
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import rank, segments
from tarnflow.session import stored

Corrections = dict[str, list[tuple[str, str]]]
KEY, BUCKET = ["stig_id", "version"], ["stig_id", "version", "artifact", "release"]


def checked(corrections: Corrections | None) -> Corrections:
    """The corrections, if each entry names two documents or more by parts and ids that differ and aren't blank; else ValueError."""
    for stig_id, documents in (corrections or {}).items():
        if len(documents) < 2:
            raise ValueError(f"correction of {stig_id}: two documents or more are needed, as it parts a colliding pair")
        for what, values in zip(("part of a path", "corrected id"), zip(*documents)):
            if any(not isinstance(v, str) or not v.strip() for v in values):
                raise ValueError(f"correction of {stig_id}: a {what} is blank or no text")
            if len(set(values)) < len(values):
                raise ValueError(f"correction of {stig_id}: two documents share a {what}")
    return corrections or {}


def families(corrections: Corrections) -> dict[str, str]:
    """Each id that a correction names or gives, with one id for all that are tied together. It has the size of the rule file."""
    head: dict[str, str] = {}

    def root(x: str) -> str:
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for stig_id, documents in corrections.items():
        for _, new in documents:
            a, b = sorted((root(stig_id), root(new)))
            head[b] = a
    return {x: root(x) for x in list(head)}


def _tied(docs: DataFrame, corrections: Corrections) -> DataFrame:
    """docs with family (null where no correction has to do with the id) and corrected_id (where exactly one part occurs in the path)."""
    spark = docs.sparkSession
    tied = spark.createDataFrame([(i, f, corrections.get(i, [])) for i, f in sorted(families(corrections).items())], "stig_id string, family string, parts array<struct<part: string, new_id: string>>")
    hits = F.filter("parts", lambda p: F.contains(F.col("path"), p["part"]))
    rows = docs.join(F.broadcast(tied), "stig_id", "left")  # a rule file's size
    return rows.withColumn("corrected_id", F.when(F.size(hits) == 1, F.get(hits, 0)["new_id"])).drop("parts")


def _plain(column: pa.Array) -> list:
    """to_pylist(), ten times as fast for the kinds that NumPy gives back unchanged."""
    kind, whole = column.type, column.null_count == 0
    if pa.types.is_string(kind) or whole and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _listed(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [_plain(batch.column(n)) for n in names]


def _rules(batch: pa.RecordBatch) -> list[list]:
    """Each row's rules; none is null."""
    column = batch.column("rules")
    flat, ends = _plain(column.flatten()), column.offsets.to_numpy()
    ends = (ends - ends[0]).tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


class _Bucket:
    """A bucket's documents as they arrive. Held are those that may still be the first of the first pair that shares no rule: before a pair is
    found one for each set of rules (a later one of the same rules has no partner before the earlier one has), afterwards those before the pair's
    first. Once many are held, a newcomer's partners are counted out rule by rule; a rule that all of them have settles it at once."""

    FEW = 16

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.known: set[frozenset] = set()
        self.at: dict = {}
        self.found = False

    def partner(self, rules: list) -> int | None:
        """The place of the first document held that shares no rule with these."""
        if len(self.held) <= self.FEW:
            return next((i for i, (own, _) in enumerate(self.held) if own.isdisjoint(rules)), None)
        if not self.at:
            self._index()
        met = [self.at[r] for r in set(rules) if r in self.at]
        if any(len(places) == len(self.held) for places in met):
            return None
        shared = set().union(*met)
        return next((i for i in range(len(self.held)) if i not in shared), None)

    def _index(self) -> None:
        self.at = defaultdict(set)
        for i, (own, _) in enumerate(self.held):
            for r in own:
                self.at[r].add(i)

    def meet(self, rules: list, doc: tuple) -> tuple | None:
        """The document that makes an earlier pair than all before with this one."""
        i = self.partner(rules)
        if i is not None:
            first = self.held[i][1]
            self.held, self.at, self.found = self.held[:i], {}, True
            return first
        if not self.found and (own := frozenset(rules)) not in self.known:
            self.known.add(own)
            if self.at:
                for r in own:
                    self.at[r].add(len(self.held))
            self.held.append((own, doc))
        return None


def _first_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pair of each id and version in this task's buckets. Rows lie by bucket and arrival, so one bucket is looked at at a time, and
    what is kept of it is what may still matter."""
    best: dict[tuple, tuple] = {}
    now, bucket, names, types = None, _Bucket(), ["stig_id", "version", "first", "second", "first_id", "second_id"], None

    def told() -> pa.RecordBatch:
        rows = [(*key, a[0], b[0], a[1], b[1]) for key, (a, b) in best.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for batch in batches:
        types = [batch.schema.field(c).type for c in ("stig_id", "version", "arrival", "arrival", "corrected_id", "corrected_id")]
        for at, doc, rules in zip(zip(*_listed(batch, *BUCKET)), zip(*_listed(batch, "arrival", "corrected_id")), _rules(batch)):
            if at != now:
                now, bucket = at, _Bucket()
            if bucket.found and not bucket.held:
                continue
            first = bucket.meet(rules, doc)
            if first is not None and ((key := at[:2]) not in best or (first[0], doc[0]) < (best[key][0][0], best[key][1][0])):
                best[key] = first, doc
        if len(best) > 10_000:
            yield told()
            best.clear()
    if best:
        yield told()


def _pairs(rows: DataFrame) -> DataFrame:
    """collisions() with first_id and second_id, the pair's corrected ids."""
    types = dict(rows.dtypes)
    lying = rows.filter(F.size("rules") > 0).select(*BUCKET, "arrival", "corrected_id", "rules").repartition(*BUCKET).sortWithinPartitions(*BUCKET, "arrival")
    found = lying.mapInArrow(_first_apart, f"stig_id string, version {types['version']}, first {types['arrival']}, second {types['arrival']}, first_id string, second_id string")
    return found.groupBy(*KEY).agg(F.min(F.struct("first", "second", "first_id", "second_id")).alias("pair")).select(*KEY, "pair.*")


def collisions(docs: DataFrame) -> DataFrame:
    """(stig_id, version, first, second): of each group the first pair of one artifact and one release whose documents have rules and share none.
    A document without rules is no second benchmark. Rows meet only within (id, version, artifact, release)."""
    return _pairs(docs.withColumn("corrected_id", F.lit(None).cast("string"))).select(*KEY, "first", "second")


def _occupancy(groups: pa.Table) -> pa.Table:
    """Whether each group of a family is split: in order of their first arrivals, with the ids that are held so far as the state."""
    held: set[str] = set()
    out = []
    for g in groups.sort_by("began").to_pylist():
        a, b = g["first_id"], g["second_id"]
        if g["first"] is None:
            verdict = "single"
        elif a is None or b is None:
            verdict = "unmapped"
        elif a == b or a in held or b in held:
            verdict = "occupied"
        else:
            verdict = "split"
        others = {x["corrected_id"] for x in g["ids"] if x["n"] > (x["corrected_id"] == a) + (x["corrected_id"] == b)}
        held |= {a, b, *others} if verdict == "split" else {g["stig_id"]}
        out.append((g["stig_id"], g["version"], verdict))
    return pa.table([pa.array([r[k] for r in out], groups.schema.field(c).type if c else pa.string()) for k, c in enumerate(("stig_id", "version", None))], ["stig_id", "version", "verdict"])


def _groups(rows: DataFrame) -> DataFrame:
    """(stig_id, version, began, first, second, verdict), a row for each group of documents, stored. Documents are summed up by id, version and
    corrected id before they are shuffled, so that no group's rows meet."""
    spread = rows.groupBy("family", *KEY, "corrected_id").agg(F.min("arrival").alias("began"), F.count("*").alias("n"))
    ids = F.collect_list(F.when(F.col("corrected_id").isNotNull(), F.struct("corrected_id", "n"))).alias("ids")  # a rule file's entry at most
    groups = stored(spread.groupBy("family", *KEY).agg(F.min("began").alias("began"), ids).join(_pairs(rows), KEY, "left"), "groups")
    version = dict(rows.dtypes)["version"]
    verdicts = groups.filter("family is not null").groupBy("family", "version").applyInArrow(_occupancy, f"stig_id string, version {version}, verdict string")
    judged = groups.join(verdicts, KEY, "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col("first").isNull(), "single").otherwise("unmapped")))
    return stored(judged.select(*KEY, "began", "first", "second", "verdict"), "verdicts")


@dataclass
class Settled:
    """documents: all, with verdict, final_id (null: discarded), turn (their order of settling) and pair; winners: those that stay, with final_id;
    departures: (final_id, version, superseded_by_library, superseded_same_key), looked for when first asked for."""

    documents: DataFrame
    winners: DataFrame

    @cached_property
    def departures(self) -> DataFrame:
        key, rank_ = ["final_id", "version"], _contest_rank()
        slim = self.documents.filter("final_id is not null").select(*key, "turn", "release", "is_library", "status_date", "artifact")
        # Of equals the first stays; whether it is the library's is part of the rank.
        led = segments.running(slim, key, [F.asc("turn")], rank_, "_lead", "max", inclusive=False, hold=lambda df: stored(df, "contests"))
        rose, by, own = rank_ > F.col("_lead"), F.col("_lead.is_library"), F.col("is_library")
        by_library = F.when(rose, own & ~by).otherwise(by & ~own)
        return led.filter("_lead is not null").groupBy(*key).agg(F.count_if(by_library).alias("superseded_by_library"), F.count_if(~by_library).alias("superseded_same_key"))

    def counters(self) -> dict[str, int]:
        """collisions, unmapped (groups that could not be split and documents that could not be renamed), departures and its two kinds, and
        corrections that stayed: by three aggregations."""
        groups = self.documents.groupBy(*KEY).agg(F.max("verdict").alias("v"), F.count_if(F.col("final_id").isNull()).alias("gone"))
        g = groups.agg(F.count_if(F.col("v") != "single").alias("found"), F.count_if(F.col("v").isin("unmapped", "occupied")).alias("kept_together"), F.coalesce(F.sum("gone"), F.lit(0)).alias("gone")).first()
        d = self.departures.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("superseded_by_library", "superseded_same_key")]).first()
        applied = self.winners.filter("verdict = 'split'").count()
        return {
            "same_key_content_collision": g.found, "same_key_collision_unmapped": g.kept_together + g.gone, "superseded_by_library": d.superseded_by_library,
            "superseded_same_key": d.superseded_same_key + g.gone, "same_key_departures": d.superseded_by_library + d.superseded_same_key + g.gone, "id_corrections_applied": applied,
        }


def _contest_rank():
    """Newer release, then the library, the later document (none counts as oldest), the artifact."""
    return F.struct(F.col("release"), F.col("is_library"), F.coalesce(F.col("status_date").cast("string"), F.lit("")).alias("dated"), F.col("artifact"))


def counted(rows: DataFrame) -> dict[str, Column]:
    """What Settled.counters says of groups and discarded documents, as sums over settled documents: a group counts where its first one lies."""
    first = F.col("arrival") == F.col("turn.began")
    return {"content_collisions": first & (F.col("verdict") != "single"), "kept_together": first & F.col("verdict").isin("unmapped", "occupied"), "discarded": F.col("final_id").isNull()}


def settled(docs: DataFrame, corrections: Corrections | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> Settled:
    """All documents settled under their final ids. A group whose first colliding pair the corrections name, and whose new ids differ and are not
    held by an earlier group of the family, is split: the pair goes to its ids, the group's others contest at theirs, and what cannot be renamed is
    discarded. Every other group contests under the id it claims. hold: what keeps the settled documents, so that winners and departures start
    from them; without it the plan runs for each."""
    rows = _tied(docs, checked(corrections))
    groups = _groups(rows).withColumnsRenamed({"stig_id": "_id", "version": "_version", "verdict": "_verdict"})
    rows = rows.join(groups, F.col("stig_id").eqNullSafe(F.col("_id")) & F.col("version").eqNullSafe(F.col("_version")), "left").withColumnRenamed("_verdict", "verdict")
    rows = rows.withColumn("pair", F.coalesce(F.col("arrival").isin(F.col("first"), F.col("second")), F.lit(False)))
    rows = rows.withColumn("final_id", F.when(F.col("verdict") == "split", F.col("corrected_id")).otherwise(F.col("stig_id"))).withColumn("turn", F.struct("began", (~(F.col("pair") & (F.col("verdict") == "split"))).alias("after"), "arrival"))
    rows = rows.drop("first", "second", "began", "corrected_id", "family", "_id", "_version")
    rows = hold(rows) if hold else rows
    standing = rows.filter("final_id is not null").withColumn("_rank", _contest_rank())
    winners = rank.winners(standing, ["final_id", "version"], [F.desc("_rank"), F.asc("turn")]).drop("_rank")
    return Settled(rows, winners)


def _brute_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each claim's first pair in this task's buckets, with what the automaton asks about its two documents. Rows lie by bucket and arrival; every
    document is held against every earlier one that could still begin the first pair. Everything from here on is written out anew."""
    least: dict[tuple, tuple] = {}
    now, waiting, known, over, schema = None, [], set(), False, None
    for batch in batches:
        schema = batch.schema
        for doc, rules in zip(zip(*_listed(batch, *BUCKET, "arrival", "is_library", "status_date", "path")), _rules(batch)):
            if doc[:4] != now:
                now, waiting, known, over = doc[:4], [], set(), False
            if over and not waiting:
                continue
            for i, (own, other) in enumerate(waiting):
                if own.isdisjoint(rules):
                    waiting, over = waiting[:i], True
                    if doc[:2] not in least or (other[4], doc[4]) < (least[doc[:2]][0][4], least[doc[:2]][1][4]):
                        least[doc[:2]] = other, doc
                    break
            else:
                if not over and (own := frozenset(rules)) not in known:  # the same rules again begin no earlier pair
                    known.add(own)
                    waiting.append((own, doc))
    rows = [(*key, *(x[k] for x in two for k in (4, 5, 6, 7)), two[0][2], two[0][3]) for key, two in least.items()]
    if rows:
        each = ["arrival", "is_library", "status_date", "path"]
        of = [(n, schema.field(n.partition("_")[2] if n[:2] in ("a_", "b_") else n).type) for n in (*KEY, *(f"{x}_{c}" for x in "ab" for c in each), "artifact", "release")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(of)], [n for n, _ in of])


def _automaton(corrections: Corrections):
    """A family's documents of one version, one event after the other: who sits where, and who left when. Rows come by family and version, claim
    after claim as they began, and in a claim first its head (which names the pair that may be parted), then its documents as they arrived. One
    document a seat is kept, and no claim."""

    def named(stig_id: str, path: str | None) -> str | None:
        hits = [new for part, new in corrections.get(stig_id, []) if path is not None and part in path]
        return hits[0] if len(hits) == 1 else None

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seats: dict[str, tuple] = {}
        table, apart, pair, types = None, False, (), None
        left: list[tuple] = []

        def sit(at: str, strength: tuple, doc: tuple) -> None:
            other = seats.get(at)
            if other is None:
                seats[at] = strength, doc
                return
            if strength > other[0]:
                seats[at], win, (lost, gone) = (strength, doc), strength, other
            else:
                win, lost, gone = other[0], strength, doc
            left.append((*gone, at, "superseded_by_library" if win[1] and not lost[1] else "superseded_same_key"))

        def rise() -> None:
            left.extend((*doc, at, "kept") for at, (_, doc) in seats.items())
            seats.clear()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in left], t) for k, t in enumerate(types)], ["stig_id", "version", "arrival", "final_id", "fate"])
            left.clear()
            return made

        for batch in batches:
            types = [*(batch.schema.field(c).type for c in ("stig_id", "version", "arrival")), pa.string(), pa.string()]
            heads = batch.column("head").to_pylist()
            for (family, stig_id, version, arrival, artifact, release, is_library, date, path), head in zip(zip(*_listed(batch, "family", *KEY, "arrival", "artifact", "release", "is_library", "status_date", "path")), heads):
                if head is not None:
                    if (family, version) != table:
                        rise()
                        table = family, version
                    two = [{c: head[f"{x}_{c}"] for c in ("arrival", "is_library", "status_date", "path")} for x in "ab"]
                    pair = tuple(d["arrival"] for d in two)
                    new = [named(stig_id, d["path"]) for d in two] if None not in pair else []
                    apart = bool(new) and None not in new and new[0] != new[1] and not any(n in seats for n in new)
                    if apart:
                        for d, n in zip(two, new):
                            sit(n, (head["release"], d["is_library"], d["status_date"] or "", head["artifact"]), (stig_id, version, d["arrival"]))
                    continue
                at, doc = stig_id, (stig_id, version, arrival)
                if apart:
                    if arrival in pair:
                        continue
                    if (at := named(stig_id, path)) is None:
                        left.append((*doc, None, "superseded_same_key"))
                        continue
                sit(at, (release, is_library, date or "", artifact), doc)
            if left:
                yield told()
        rise()
        if left:
            yield told()

    return play


def replayed(docs: DataFrame, corrections: Corrections | None = None) -> DataFrame:
    """(stig_id, version, arrival, final_id, fate: kept, superseded_by_library or superseded_same_key): the arbitration replayed event by event, a
    family and version in one task, of which it keeps one document a seat. The pairs that collide are found before, bucket by bucket."""
    types, corrections = dict(docs.dtypes), checked(corrections)
    of = families(corrections)
    mapped = F.create_map(*[F.lit(x) for pair in sorted(of.items()) for x in pair]) if of else None
    family = F.coalesce(mapped[F.col("stig_id")], F.col("stig_id")) if of else F.col("stig_id")
    rows = docs.select(*BUCKET, "arrival", "is_library", F.col("status_date").cast("string").alias("status_date"), "path", "rules")
    of_doc = f"arrival {types['arrival']}, is_library boolean, status_date string, path string"
    head = ", ".join([*(f"{x}_{c}" for x in "ab" for c in of_doc.split(", ")), f"artifact {types['artifact']}", f"release {types['release']}"])
    lying = rows.filter(F.size("rules") > 0).repartition(*BUCKET).sortWithinPartitions(*BUCKET, "arrival")
    found = lying.mapInArrow(_brute_pairs, f"stig_id string, version {types['version']}, {head}")
    names = [c.split(" ")[0] for c in head.split(", ")]
    least = found.groupBy(*KEY).agg(F.min(F.struct("a_arrival", "b_arrival", *[n for n in names if n[2:] != "arrival"])).alias("p"))
    began = rows.groupBy(*KEY).agg(F.min("arrival").alias("began")).join(least, KEY, "left")
    claims = stored(began.select(*KEY, "began", F.struct(*[F.col(f"p.{n}").alias(n) for n in names]).alias("head")), "heads")
    known = claims.select(F.col("stig_id").alias("_id"), F.col("version").alias("_version"), "began")
    events = rows.drop("rules").join(known, F.col("stig_id").eqNullSafe(F.col("_id")) & F.col("version").eqNullSafe(F.col("_version")), "left").drop("_id", "_version")
    events = events.unionByName(claims, allowMissingColumns=True).withColumn("family", family)
    # A claim's head has no arrival, so it comes before the documents.
    order = ["family", "version", "began", F.col("head").isNull(), "arrival"]
    dealt = events.repartition("family", "version").sortWithinPartitions(*order)
    return dealt.mapInArrow(_automaton(corrections), f"stig_id string, version {types['version']}, arrival {types['arrival']}, final_id string, fate string")


def tallied(replay: DataFrame) -> DataFrame:
    """(final_id, version, winner: its arrival, superseded_by_library, superseded_same_key) of replayed(); discarded documents aside."""
    fates = [F.count_if(F.col("fate") == c).alias(c) for c in ("superseded_by_library", "superseded_same_key")]
    return replay.filter("final_id is not null").groupBy("final_id", "version").agg(F.max(F.when(F.col("fate") == "kept", F.col("arrival"))).alias("winner"), *fates)


def disagreements(plan: Settled, replay: DataFrame) -> DataFrame:
    """Where plan and replay differ: (final_id, version, what, planned, replayed), what being a winner's arrival or one of the departures' counts."""
    return differing(plan, tallied(replay))


def differing(plan: Settled, told: DataFrame) -> DataFrame:
    """disagreements() with what tallied() gave."""
    key = ["final_id", "version"]
    won = plan.winners.select(*key, F.col("arrival").cast("string").alias("winner")).join(plan.departures, key, "left").na.fill(0, ["superseded_by_library", "superseded_same_key"])

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.posexplode(F.array(F.col("winner").cast("string"), F.col("superseded_by_library").cast("string"), F.col("superseded_same_key").cast("string"))).alias("k", name))

    both = long(won, "planned").join(long(told, "replayed"), [*key, "k"], "full").filter(~F.col("planned").eqNullSafe(F.col("replayed")))
    return both.select(*key, F.element_at(F.array(*map(F.lit, ("winner", "superseded_by_library", "superseded_same_key"))), F.col("k") + 1).alias("what"), "planned", "replayed")
