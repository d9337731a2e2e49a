"""Mains, constraints, pairs of them, similar mains, merged and final questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import fact_marks, marked_same_fact
from ..functions.relations import GAP, marked_signal, signal_word, span_marks
from ..functions.text import squeeze, word_count
from ..session import stored

MAX_WORDS = 80


#: Pairs of an entity beyond which its mains and constraints meet by time as well.
HUB_PAIRS = 4_000_000
#: Slots of entities that are counted for hubs.
HUB_SLOTS = 1 << 18
#: Widths of the time buckets, in yyyymmdd integers; a span lies at the least one that is as wide as it.
WIDTHS = (8, 32, 128, 512, 2_048, 8_192, 32_768, 1 << 31)


def _bucketed(rows: DataFrame, begin: str, end: str, pad: int, roles: dict[bool, tuple[str, ...]]) -> DataFrame:
    """Rows once for each bucket that their span and ``pad`` on both sides touch, one or two of its own width and of each greater width, with ``first``, the first of them, and ``role``."""
    lo, hi = F.least(begin, end) - pad, F.greatest(begin, end) + pad
    length = hi - lo + 1
    own = F.lit(len(WIDTHS) - 1)
    for level in range(len(WIDTHS) - 2, -1, -1):
        own = F.when(length <= WIDTHS[level], level).otherwise(own)

    def touched(level: int, width: int) -> Column:
        a, z = F.floor(lo / width), F.floor(hi / width)
        each = F.transform(F.sequence(a, z), lambda k: F.struct(F.lit(level).alias("level"), k.alias("bucket"), a.alias("first"), (own == level).alias("home")))
        return F.when(own <= level, each).otherwise(F.array().cast("array<struct<level:int,bucket:bigint,first:bigint,home:boolean>>"))

    placed = rows.select("*", F.inline(F.flatten(F.array(*[touched(i, w) for i, w in enumerate(WIDTHS)]))))
    role = F.when(F.col("home"), F.array(*map(F.lit, roles[True]))).otherwise(F.array(*map(F.lit, roles[False])))
    return placed.withColumn("role", F.explode(role)).drop("home")


def near_in_time(left: DataFrame, right: DataFrame, pad: int) -> DataFrame:
    """Pairs of one ``entity`` whose spans ``(b, e)`` and ``(cs, ce)`` are at most ``pad`` apart, each once.

    A span has buckets of its own width, where it is at home, and of greater ones, where it visits. Those at home meet each other and visitors, so
    a pair meets at the wider span's width alone; of two common buckets the first counts.
    """
    m = _bucketed(left, "b", "e", pad, {True: ("both", "left"), False: ("right",)}).withColumnRenamed("first", "m_first")
    c = _bucketed(right, "cs", "ce", 0, {True: ("both", "right"), False: ("left",)}).withColumnRenamed("first", "c_first")
    met = m.join(c, ["entity", "level", "bucket", "role"]).where(_near(pad) & (F.col("bucket") == F.greatest("m_first", "c_first")))
    return met.drop("level", "bucket", "role", "m_first", "c_first")


def _near(pad: int) -> Column:
    """Whether spans ``(b, e)`` and ``(cs, ce)`` are at most ``pad`` apart."""
    return (F.least("b", "e") - pad <= F.greatest("cs", "ce")) & (F.greatest("b", "e") + pad >= F.least("cs", "ce"))


def _hubs(left: DataFrame, right: DataFrame, hub_pairs: int) -> DataFrame | None:
    """Entities with more than ``hub_pairs`` possible pairs, none if there are no such. Only those in slots of entities that have more together are counted one by one."""
    one = lambda rows, m, c: rows.select("entity", F.pmod(F.xxhash64("entity"), F.lit(HUB_SLOTS)).alias("slot"), F.lit(m).alias("m"), F.lit(c).alias("c"))
    rows = one(left, 1, 0).unionByName(one(right, 0, 1)).where("entity is not null")
    beyond = lambda rows, by: rows.groupBy(by).agg(F.sum("m").alias("m"), F.sum("c").alias("c")).where(F.col("m") * F.col("c") > hub_pairs).select(by)
    slots = stored(beyond(rows, "slot"), "hub-slots")
    if slots.isEmpty():
        return None
    hubs = stored(beyond(rows.join(slots, "slot"), "entity"), "hubs")
    return None if hubs.isEmpty() else hubs


def _met(left: DataFrame, right: DataFrame, pad: int, hub_pairs: int) -> DataFrame:
    """Pairs of one ``entity`` that are near in time; those of hub entities meet by time."""

    def joined(left: DataFrame) -> DataFrame:
        # The hash is joined as well: rows are sorted by it without a look at the names, many of which begin alike.
        hashed = lambda rows: rows.withColumn("_h", F.xxhash64("entity"))
        return hashed(left).join(hashed(right), ["_h", "entity"]).where(_near(pad)).drop("_h")

    hubs = _hubs(left, right, hub_pairs)
    if hubs is None:
        return joined(left)
    hub = near_in_time(left.join(hubs, "entity", "left_semi"), right.join(hubs, "entity", "left_semi"), pad)
    return joined(left.join(hubs, "entity", "left_anti")).unionByName(hub)


def temporal_pairs(mains: DataFrame, constraints: DataFrame, max_words: int | None = MAX_WORDS, gap_mode: str = "int", suppress_same_fact: bool = True, hub_pairs: int = HUB_PAIRS, main_columns: tuple[str, ...] = (), constraint_columns: tuple[str, ...] = ()) -> DataFrame:
    """Mains with constraints that share a question entity, hold none of the answers, and stand before, after or during.

    ``mains``: (main_id, text, begin, end, question_ids, answer_ids), ``constraints``: (constraint_id,
    text, begin, end, entity_ids); spans as integers, a row without one pairs with nothing. Pairs that tell one fact go: of equal items only those of the
    question count, as a constraint with an answer is none anyway. A column ``told`` of mains, if there is one, is what
    these tests and the word limit read instead of ``text``. Both sides are dealt by entity, so the pairs meet
    by an equi-join; an entity with more than ``hub_pairs`` of them is dealt by time as well. A pair that
    shares several entities is kept where it meets on the least of them, which needs no further shuffle.
    Pairs keep ``main_columns`` and ``constraint_columns``, so that neither side has to be joined to them again.
    """
    told = F.col("told" if "told" in mains.columns else "text")
    themes = lambda c: F.array(*fact_marks(c)) if suppress_same_fact else F.array().cast("array<boolean>")
    n = lambda c: word_count(c) if max_words is not None else F.lit(0)
    dated = lambda rows: rows.where(F.col("begin").isNotNull() & F.col("end").isNotNull())
    span = span_marks(F.col("begin"), F.col("end"))
    m = dated(mains).select("main_id", F.col("text"), F.col("begin").alias("b"), F.col("end").alias("e"), span.alias("m_span"), "question_ids", "answer_ids", n(told).alias("n"), themes(told).alias("themes"), *[x for x in main_columns if x not in ("text", "question_ids", "answer_ids")])
    c = dated(constraints).select("constraint_id", F.col("text").alias("constraint_text"), F.col("begin").alias("cs"), F.col("end").alias("ce"), span.alias("c_span"), "entity_ids", n(F.col("text")).alias("cn"), themes("text").alias("c_themes"), *constraint_columns)
    # What a pair needs is worked out once for each side; the texts stay with it, as a pair shows both.
    left = m.withColumn("entity", F.explode(F.array_distinct("question_ids")))
    right = c.withColumn("entity", F.explode(F.array_distinct("entity_ids")))
    met = _met(left, right, GAP if gap_mode == "int" else GAP * 10_000, hub_pairs).where(F.col("main_id") != F.col("constraint_id"))
    if max_words is not None:
        met = met.where(F.col("n") + F.col("cn") <= max_words)
    # By lambdas, whose code stays outside: with set operations in it the JVM would not compile it.
    held = lambda x: F.array_contains("entity_ids", x)
    kept = F.forall("question_ids", lambda q: (q >= F.col("entity")) | ~held(q)) & ~F.exists("answer_ids", held)
    if suppress_same_fact:
        kept = kept & ~marked_same_fact(F.col("themes"), F.col("c_themes"), F.col("b"), F.col("e"), F.col("cs"), F.col("ce"), F.col("question_ids"), F.col("entity_ids"))
    signal = marked_signal(F.col("m_span"), F.col("c_span"), gap_mode)
    # A generator keeps these tests out of the join, which is compiled with the short ones above and leaves few pairs.
    met = met.select("*", F.explode(F.array(F.when(signal.isNotNull(), F.when(kept, signal)))).alias("signal")).where("signal is not null")
    return met.select("main_id", "constraint_id", "signal", pseudo_question(F.col("text"), F.col("signal"), F.col("constraint_text")).alias("question"), "b", "e", "cs", "ce", *main_columns, *constraint_columns)


def pseudo_question(main: Column, relation: Column, constraint: Column) -> Column:
    return squeeze(F.concat_ws(", ", main, signal_word(relation), constraint))


def main_parts(evidence: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Mains from ``(evidence_id, source, candidate_question_text, answers array<struct<id, label, type, disam_label>>, entities array<struct<id>>)``.

    The first answer is asked for; its name leaves the text; all other entities are the question's. Further ``columns`` stay with them.
    """
    a = F.get("answers", F.lit(0))
    name = F.when(F.col("source") == "kb", a["label"]).otherwise(a["disam_label"])
    rest = F.filter(F.col("entities")["id"], lambda x: x != a["id"])
    bare = F.when(F.coalesce(name, F.lit("")) == "", F.col("candidate_question_text")).otherwise(F.replace("candidate_question_text", name, F.lit(" ")))
    out = evidence.where(F.size("answers") > 0).withColumn("_bare", bare).withColumn("_asked", F.concat_ws(" ", F.lit("What"), a["type"], "_bare"))
    single = lambda c: F.trim(F.when(F.contains(F.col(c), F.lit("  ")), squeeze(F.col(c))).otherwise(F.col(c)))
    return out.select("evidence_id", "source", a["id"].alias("answer_id"), F.array_distinct(rest).alias("question_ids"), single("_bare").alias("main_question_text"), single("_asked").alias("main_pseudo_question"), *columns)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v))
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm))


#: Vectors of a topic that are compared in one task with as many others; a topic with more is dealt over several tasks.
TILE = 4096


#: Rows of a tile whose products with another tile are in memory at a time.
STRIP = 64


def _runs(batches, by: list[str]):
    """Sorted batches as ``(values, slices)`` of each run of equal values in the columns ``by``; a run may go over several batches."""
    head, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.zeros(batch.num_rows - 1, bool)
        for c in by:
            column = batch.column(c)
            ends |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(ends) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            own = tuple(batch.column(c)[start].as_py() for c in by)
            if parts and own != head:
                yield head, parts
                parts = []
            head = own
            parts.append(batch.slice(start, end - start))
    if parts:
        yield head, parts


def _tiled(rows: DataFrame, topic: str, tile: int) -> DataFrame:
    """``rows (topic, key, vector)`` with the pair of tiles ``(_i, _j)``, i <= j, in which they are compared, and their own tile ``_t``; small topics are one tile."""
    zero = F.lit(0)
    large = stored(rows.groupBy(topic).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile).select(topic, F.ceil(F.col("_n") / tile).cast("int").alias("_tiles")), "large-topics")
    if large.isEmpty():
        return rows.withColumns({"_t": zero, "_i": zero, "_j": zero})
    own = F.pmod(F.xxhash64("_key"), F.coalesce("_tiles", F.lit(1))).cast("int")
    dealt = rows.join(large, topic, "left").withColumn("_t", own).withColumn("_k", F.explode(F.sequence(zero, F.coalesce("_tiles", F.lit(1)) - 1)))
    return dealt.select(topic, "_key", "_v", "_t", F.least("_t", "_k").alias("_i"), F.greatest("_t", "_k").alias("_j"))


def cosines(rows: DataFrame, key: str, topic: str, vector: str, least: float, tile: int = TILE) -> DataFrame:
    """Pairs ``(topic, key, other, score)``, key < other, of one topic whose cosine is above ``least``, as matrix products of tiles.

    Null and zero vectors and those with null or non-finite components have no cosine; vectors of a topic have one length. A null topic or key has no pairs.
    """
    t = rows.schema
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    good = rows.where(finite & F.col(topic).isNotNull() & F.col(key).isNotNull()).select(topic, F.col(key).alias("_key"), F.col(vector).alias("_v"))

    kind = lambda c: t[c].dataType.simpleString()
    names = [topic, "_a", "_b", "score"]

    def compare(head: tuple, parts: list[pa.RecordBatch]):
        """Strips of a pair of tiles' products: what is found in one goes on before the next is made."""
        keys, own = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("_key", "_t"))
        x = np.concatenate([p.column("_v").flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.float64).reshape(len(keys), -1)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        name, i, j = head
        left, right = (slice(None), slice(None)) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        a_keys, b_keys, x_right = keys[left], keys[right], x[right].T
        x = x[left]
        for at in range(0, len(x), STRIP):
            score = x[at : at + STRIP] @ x_right
            a, b = np.nonzero(score > least)
            some, others = a_keys[at + a], b_keys[b]
            # A tile meets itself in both orders.
            kept = some < others if i == j else some != others
            yield name, some[kept], others[kept], score[a[kept], b[kept]]

    def run(batches):
        types = None
        held, size = [], 0

        def flushed():
            return pa.RecordBatch.from_arrays([
                pa.array([h[0] for h in held], types[0]).take(pa.array(np.repeat(np.arange(len(held)), [len(h[1]) for h in held]))),
                *[pa.array(np.concatenate([h[c] for h in held]), types[c]) for c in (1, 2, 3)],
            ], names=names)

        for head, parts in _runs(batches, [topic, "_i", "_j"]):
            types = types or [parts[0].column(topic).type, parts[0].column("_key").type, parts[0].column("_key").type, pa.float64()]
            for found in compare(head, parts):
                held.append(found)
                size += len(found[1])
                if size >= 1 << 16 or len(held) >= 1 << 12:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    # As many tasks as the session says, not as few as the bytes would fill: the work grows with the square of a tile.
    dealt = _tiled(good, topic, tile).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), topic, "_i", "_j").sortWithinPartitions(topic, "_i", "_j")
    found = dealt.mapInArrow(run, f"`{topic}` {kind(topic)}, _a {kind(key)}, _b {kind(key)}, score double")
    return found.select(topic, F.least("_a", "_b").alias(key), F.greatest("_a", "_b").alias("other"), "score")


def similar_pairs(rows: DataFrame, key: str, topic: str, vector: str, threshold: Column | float, distinct: str | None = None, least: float | None = None, tile: int = TILE) -> DataFrame:
    """Pairs ``key < other`` of one topic whose cosine is above ``threshold``; ``distinct`` names a column in which they must differ.

    A threshold column may use ``source`` and ``other_source``; ``least`` is then the least value it can take, pairs below which are never made. Keys are unique in a topic.
    """
    if least is None:
        least = threshold if isinstance(threshold, float) else -2.0
    one = rows.drop(vector)
    keep = [c for c in one.columns if c != topic]
    other = one.select(topic, *[F.col(c).alias("other" if c == key else f"other_{c}") for c in keep])
    met = cosines(rows, key, topic, vector, least, tile).join(one, [topic, key]).join(other, [topic, "other"])
    if distinct:
        met = met.where(F.col(distinct) != F.col(f"other_{distinct}"))
    return met.where(F.col("score") > threshold)


def similar_threshold(source: Column, other: Column, text: float = 0.7, rest: float = 0.9) -> Column:
    return F.when((source == "text") | (other == "text"), text).otherwise(rest)


def similar_questions(questions: DataFrame, similar: DataFrame) -> DataFrame:
    """Later questions of a topic with the same constraint and signal whose main is similar: ``(topic, question_id, other_id)``.

    ``questions``: (topic, question_id, main_id, constraint_id, signal), ordered by question_id;
    ``similar``: (main_id, other).
    """
    way = lambda a, b: F.struct(F.col(a).alias("main_id"), F.col(b).alias("other_main"))
    both = similar.select(F.inline(F.array(way("main_id", "other"), way("other", "main_id")))).distinct()
    later = questions.select("topic", F.col("question_id").alias("other_id"), F.col("main_id").alias("other_main"), "constraint_id", "signal")
    return questions.join(later, ["topic", "constraint_id", "signal"]).where("question_id < other_id").join(both, ["main_id", "other_main"]).select("topic", "question_id", "other_id")


def merge_similar(questions: DataFrame, pairs: DataFrame, fields: list[str], drop_absorbed: bool = False) -> DataFrame:
    """Questions with their similar ones' ``fields`` as an array by id; absorbed ones stay unless asked."""
    absorbed = questions.select(F.col("question_id").alias("other_id"), F.struct(F.col("question_id").alias("id"), *fields).alias("copy"))
    held = pairs.join(absorbed, "other_id").groupBy("question_id").agg(F.array_sort(F.collect_list("copy")).alias("similar"))
    out = questions.join(held, "question_id", "left")
    return out.join(pairs.select(F.col("other_id").alias("question_id")).distinct(), "question_id", "left_anti") if drop_absorbed else out


def with_slots_of_similar(questions: DataFrame, slots: tuple[str, ...], main_id: str = "main_id", answer: str = "answers", entities: str | None = None) -> DataFrame:
    """Questions with what their ``similar`` ones tell of the same constraint.

    ``slots`` are arrays that begin with the main's slot and end with the constraint's; the similar questions' own main slots (their
    first) come behind the first one, the last similar question's foremost. ``answer`` takes their answers at its end, ``main_ids`` is the
    main's id and theirs, and ``entities``, the main's different entities, take theirs that they lack. Null or empty ``similar`` changes nothing.
    """
    t = questions.schema
    like = F.coalesce("similar", F.array().cast(t["similar"].dataType))
    of = lambda c: F.transform(like, lambda x: x[c])
    first = lambda c: F.reverse(F.transform(like, lambda x: F.get(x[c], F.lit(0))))
    merged = {c: F.concat(F.slice(c, 1, 1), first(c), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))) for c in slots}
    merged[answer] = F.concat(answer, F.flatten(of(answer)))
    merged["main_ids"] = F.concat(F.array(main_id), of(main_id))
    if entities:
        merged[entities] = F.array_union(entities, F.flatten(of(entities)))
    return questions.withColumns(merged)


def source_centric(questions: DataFrame) -> DataFrame:
    """Per topic: has a question with kb and no text (kb_centric), with text and no kb (text_centric)."""
    has = lambda s: F.array_contains("source", s)
    return questions.groupBy("topic").agg(F.bool_or(has("kb") & ~has("text")).alias("kb_centric"), F.bool_or(has("text") & ~has("kb")).alias("text_centric"))


def first_by(items: Column, field: str) -> Column:
    """Structs, the first of each ``field``."""
    return F.filter(items, lambda x, i: F.forall(F.slice(items, F.lit(1), i), lambda y: y[field] != x[field]))


def final_questions(questions: DataFrame) -> DataFrame:
    """The published form: the last slot is the constraint; mains pair with the first slot of equal evidence; entities and answers once each."""
    n = F.size("evidence")
    slot = lambda i: F.struct(F.get("evidence", i).alias("evidence"), F.get("source", i).alias("source"), F.get("timespan", i).alias("timespan"))
    mains = F.transform(F.slice("evidence", F.lit(1), n - 1), lambda x: slot((F.array_position("evidence", x) - 1).cast("int")))
    return questions.select(
        F.col("rephrase_question"), F.col("pseudo_question_construction"), F.struct(mains.alias("main"), slot(n - 1).alias("constraint")).alias("evidence"), "signal", "topic_entity",
        first_by(F.flatten("question_entity"), "id").alias("question_entity"), first_by(F.col("answer"), "id").alias("answer"),
    )


def last_per_key(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Cache upsert: of each key the row of the greatest version; the new side wins ties."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_side"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_side")


def carried_header(rows: DataFrame, group: str, order: list[str], header: Column, name: str = "header") -> DataFrame:
    """Rows with the last header before or at them, within their group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(header, ignorenulls=True).over(w))
