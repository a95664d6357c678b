"""Near-duplicate join on word shingles: Jaccard similarity with prefix filters under several global token orders.

A document is the set of its distinct five-word shingles (as 64-bit hashes). Equal sets form a class, and only classes are
joined. Under any order of all shingles two sets of similarity t share a shingle among the first n - ceil(t * n) + 1 of
each. The orders used here all put shingles that many documents hold last (by an estimate that misses only what is rare
within every batch, and that never decides a result) and break ties by hashes of their own.

The result needs components, not pairs, so no posting list is expanded into pairs. In an index of the first order the members
of each list are chained by size; the components of all chains are cells, and linked sets lie in one cell. A list there is
of three shingles that follow each other in the order, in a prefix that is longer for it: two long texts that share a
passage often have single shingles of it in their prefixes, hardly ever three in a row. Most sets are alone in their cell
and are done. The others are written once, as arrays of hashes, and each cell goes to one task, whole. There a candidate has
to share prefix shingles in every order (the filters are intersected) before the sets are compared, and sets that are known
to be in one component are not compared with each other.

A cell over BLOCK_BYTES is first cut finer by indexes in the other orders. What then is still over BLOCK_BYTES is cut into
blocks of like sizes, joined within the blocks, and merged into components. One component of such a cell, the largest, is not
compared with itself again: only the sets outside of it meet all blocks of a size that can be similar. So no link between
components is lost, at a cost of pairs of blocks, not of rows.

Cases: a text without words, or null, has an empty set and is alone; fewer words than five are one shingle; a very long text
is hashed in pieces and may fill a block of its own; ties of the orders are broken by hashes and decide no result; rows that
repeat a doc_id count as documents of that id; a null doc_id is never a component_id, and a component without any other has
null; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.operators.components import connected_components
from sylvan.operators.local import labels
from sylvan.runtime import discard, join_per_key, materialize

from .common import broadcast_if_few, free_name, sparing, sparing_groups, text_or_empty
from .shingles import DENOMINATOR, NUMERATOR, RUN, Orders, U, links_between, links_within, mix, shingle_sets, signature

#: Shingles that so many classes of a batch (or HELD shingles) hold are reported; the most frequent MOST_FREQUENT of all are put last.
LOCAL, MOST_FREQUENT = 4, 1 << 19
#: Shingles or entries of sets that a worker holds at once: a batch beyond is taken in parts, but no set is cut.
HELD = 1 << 19
#: Prefix entries for each partition of the index, bytes of sets that one comparison loads, bytes of sets for each task.
PART_ENTRIES, BLOCK_BYTES, TASK_BYTES = 1 << 20, 4 << 20, 16 << 20
#: Sizes in one step differ by sqrt(5 / 4) at most, similar ones by STEPS steps. In a chain of one size of each step, neighbours
#: that stand for similar sets differ by 5 / 4 * sqrt(5 / 4) ** 2 = 1.5625 at most.
STEP, STEPS, CHAIN = float(np.log(DENOMINATOR / NUMERATOR) / 2), 3, 1.6
SETS = "rk bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, tokens binary, counts binary"
INDEX = "part int, tokens binary, counts binary, classes binary"
CELL_SETS = "cid bigint, cell bigint, big boolean, copies bigint, n bigint, shingles binary"
LINKS = "a bigint, b bigint"


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), text_or_empty())


def document_sets(docs: DataFrame) -> DataFrame:
    """rk (key of the row), doc_id, size and signature of each row's set; and rows for each batch with its frequent shingles."""
    names = [x.split()[0] for x in SETS.split(", ")]

    def report(sets: list[np.ndarray]) -> pd.DataFrame:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        many = counts >= LOCAL
        columns = {"tokens": [tokens[many].tobytes()], "counts": [counts[many].astype("<i8").tobytes()]}
        return pd.DataFrame(dict.fromkeys(names[:5], [None]) | columns).astype(dict.fromkeys(names[:5], "Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, signs, held, size = [], [], {}, 0
            for s in shingle_sets(pdf.text.tolist()):
                signs.append(signature(s))
                sizes.append(len(s))
                if signs[-1] not in held:
                    held[signs[-1]] = s
                    size += len(s)
                if size >= HELD:
                    yield report(list(held.values()))
                    held, size = {}, 0
            if held:
                yield report(list(held.values()))
            one, two = np.array(signs, np.int64).reshape(-1, 2).T
            out = pd.DataFrame({"rk": pdf.rk, "doc_id": pdf.doc_id.astype("Int64"), "n": sizes, "s1": one, "s2": two, "tokens": None, "counts": None})
            yield out.astype({"n": "Int64", "rk": "Int64", "s1": "Int64", "s2": "Int64"})

    rows = docs.select(_row_key().alias("rk"), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(sparing(run), SETS)


def frequent(sets: DataFrame) -> Orders:
    """The orders, from the batches' reports. At most MOST_FREQUENT shingles come to the driver: those over a count that so few reach."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, c in zip(pdf.tokens, pdf.counts, strict=True):
                yield pd.DataFrame({"token": np.frombuffer(t, "<i8"), "count": np.frombuffer(c, "<i8")})

    reports = sets.where("tokens is not null").select("tokens", "counts").mapInPandas(sparing(unpack), "token bigint, count bigint")
    found = materialize(reports.groupBy("token").agg(F.sum("count").alias("count")), "frequent")
    level = F.floor(F.log2("count") * 4)
    levels = found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # some hundred rows at most
    total, least = 0, None
    for r in levels:
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = r["level"]
    if least is None:
        return Orders(np.zeros(0, U), np.zeros(0))
    pdf = found.where(level >= least).toPandas()
    discard(found)
    tokens = pdf.token.to_numpy(np.int64).view(U)
    order = np.argsort(tokens)
    return Orders(tokens[order], pdf["count"].to_numpy(float)[order])


def _step(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(sizes) / STEP).astype(np.int64)


def _chained(tokens: np.ndarray, sizes: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbours in the lists of equal tokens sorted by size, and the positions of one entry for each token and step of sizes."""
    order = np.argsort(tokens)
    t = tokens[order]
    same = np.concatenate(([False], t[1:] == t[:-1], [False]))
    listed = same[1:] | same[:-1]
    single, order = order[~listed], order[listed]
    order = order[np.lexsort((members[order], sizes[order], tokens[order]))]
    t, s, m = tokens[order], sizes[order], members[order]
    same = t[1:] == t[:-1]
    near = same & (s[1:] <= CHAIN * s[:-1]) & (m[1:] != m[:-1])
    step = _step(s)
    first = np.concatenate(([True], ~same | (step[1:] != step[:-1])))[: len(s)]
    return m[1:][near], m[:-1][near], np.concatenate((single, order[first]))


def _stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (id, least id of its component) for the pairs."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    pairs = np.unique(np.stack([a, b]), axis=1)
    out = np.stack(labels(*pairs), axis=1)
    return out[out[:, 0] != out[:, 1]]


#: From a batch: the id of each set, its hashes, and a number that its tokens are mixed with (0: none).
Reader = Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray, int]]]


def _sets_of_texts(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, int]]:
    for s in shingle_sets(pdf.text.tolist()):
        if len(s) >= NUMERATOR:  # smaller sets are similar to equal ones alone
            yield signature(s)[0], s, 0


def _sets_of_cells(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, int]]:
    for cid, cell, shingles in zip(pdf.cid.tolist(), pdf.cell.tolist(), pdf.shingles, strict=True):
        yield cid, np.frombuffer(shingles, U), cell


def run_index(source: DataFrame, read: Reader, orders: Orders, order: int, parts: int) -> DataFrame:
    """Entries of the runs in an order's prefixes, a row for each batch and partition: classes (id, size), entries of each, tokens.

    A token is 32 bits of a run's hash, besides its partition: runs that clash make cells coarser and no more. A batch chains
    the lists it holds itself and sends on one member for each step of sizes, so a run that all documents hold costs an
    entry or few for each batch. Rows without classes hold in tokens the stars of a batch's chains.
    """
    shared = source.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[int, int] = {}
            tokens, held = [], 0
            for name, s, cell in read(pdf):
                if name in known:
                    continue
                tokens.append(mix(shared.value.runs(s, order) + U(cell % (1 << 64))))
                known[name] = len(s)
                held += len(tokens[-1])
                if held >= HELD:
                    yield from rows(known, tokens)
                    known, tokens, held = {}, [], 0
            if known:
                yield from rows(known, tokens)

    def rows(known: dict[int, int], tokens: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        table = np.array([list(known), list(known.values())], np.int64).T
        member = np.repeat(np.arange(len(table)), [len(t) for t in tokens])
        token = np.concatenate(tokens)
        a, b, keep = _chained(token, table[member, 1], member)
        stars = _stars(table[a, 0], table[b, 0])
        token, member = token[keep], member[keep]
        # Entries by partition, then by class.
        place = (token % U(parts)).astype(np.int64) * len(table) + member
        by_place = np.argsort(place)
        place, token = place[by_place], (token[by_place] >> U(32)).astype("<u4")
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
        part, member = np.divmod(place[starts[:-1]], len(table))
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        out = {"part": part[cuts[:-1]], "tokens": [token[starts[i] : starts[j]].tobytes() for i, j in spans]}
        out["counts"] = [np.diff(starts[i : j + 1]).astype("<i4").tobytes() for i, j in spans]
        out["classes"] = [table[member[i:j]].tobytes() for i, j in spans]
        yield pd.DataFrame(out)
        if len(stars):
            yield pd.DataFrame([{"part": int(stars[0, 0]) % parts, "tokens": stars.tobytes(), "counts": b"", "classes": b""}])

    return source.mapInPandas(sparing(run), INDEX)


def chains(index: DataFrame) -> DataFrame:
    """a, b: pairs of ids whose components are the cells of the index."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf.classes.map(len) == 0
        found = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in pdf.tokens[done]]
        pdf = pdf[~done]
        if len(pdf):
            tokens = np.concatenate([np.frombuffer(x, "<u4") for x in pdf.tokens])
            counts = np.concatenate([np.frombuffer(x, "<i4") for x in pdf.counts])
            classes = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in pdf.classes])
            member = np.repeat(np.arange(len(classes)), counts)
            a, b, _ = _chained(tokens, classes[member, 1], classes[member, 0])
            found.append(np.stack([a, b], axis=1))
        rows = np.concatenate(found)
        rows = _stars(rows[:, 0], rows[:, 1])
        return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1]})

    return index.groupBy("part").applyInPandas(sparing_groups(merge), LINKS)


def cells(source: DataFrame, read: Reader, orders: Orders, order: int, entries: int) -> DataFrame:
    """id and component (cell) of every set that shares a run in the prefix of the order with another of like size.

    entries: shingles of all sets.
    """
    entries = entries * RUN // DENOMINATOR
    parts = max(entries // PART_ENTRIES + 1, min(32, entries // 250_000 + 1))
    found = materialize(chains(run_index(source, read, orders, order, parts)), "chains")
    out = materialize(connected_components(found, "a", "b"), "cells")
    discard(found)
    return out


def cell_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The set of each class in need (rk, cid, s1, cell, big, copies), from the text of the class's first row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # classes of this task
        for pdf in batches:
            pdf = pdf[~pdf.cid.isin(seen)].drop_duplicates("cid")
            seen.update(pdf.cid.tolist())
            sets = list(shingle_sets(pdf.text.tolist()))
            own = np.array([signature(s)[0] for s in sets], np.int64) == pdf.s1.to_numpy()
            out = pdf[["cid", "cell", "big", "copies"]].assign(n=[len(s) for s in sets], shingles=[s.tobytes() for s in sets])
            yield out[own]

    few = broadcast_if_few(need)
    texts = docs.select(_row_key().alias("rk"), text_or_empty().alias("text")).join(few, "rk")
    return texts.select("cid", "s1", "cell", "big", "copies", "text").mapInPandas(sparing(run), CELL_SETS)


def _one_each(sets: DataFrame) -> DataFrame:
    """sets with one row for each class: only a class of several rows can be there twice, from tasks that hold equal rows of it."""
    return sets.where("copies = 1").unionByName(sets.where("copies > 1").dropDuplicates(["cid"]))


def _bytes() -> Column:
    return F.col("n") * 8 + 64


def _links_of_blocks(sets: DataFrame, block: str, total: int, orders: Orders) -> DataFrame:
    """a, b (cid): links that span the components within each block of sets. Whole blocks are dealt to tasks of some TASK_BYTES."""
    shared = sets.sparkSession.sparkContext.broadcast(orders)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("block", sort=False):
            ids = own.cid.tolist()
            out += [(ids[x], ids[y]) for x, y in links_within([np.frombuffer(s, U) for s in own.shingles], shared.value)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    bins = max(total // TASK_BYTES + 1, min(64, total // (TASK_BYTES // 16) + 1))
    dealt = sets.select(F.pmod(F.xxhash64(block), F.lit(bins)).alias("bin"), F.col(block).alias("block"), "cid", "shingles")
    return dealt.groupBy("bin").applyInPandas(sparing_groups(run), LINKS)


def _links_of_big_cells(sets: DataFrame, orders: Orders) -> list[DataFrame]:
    """Links that span the components of cells over BLOCK_BYTES."""
    written = [sets]
    for order in (1, 2):
        entries = sets.agg(F.sum("n")).first()[0] or 0
        finer = cells(sets, _sets_of_cells, orders, order, entries)
        few = broadcast_if_few(finer)
        sets = sets.drop("cell").join(few.select(F.col("id").alias("cid"), F.col("component").alias("cell")), "cid")
        sets = materialize(sets.select("cid", "cell", "n", "shingles"), "big_cells")
        written += [finer, sets]
        if not sets.groupBy("cell").agg(F.sum(_bytes()).alias("b")).where(F.col("b") > BLOCK_BYTES).limit(1).count():
            break
    step = F.floor(F.log("n") / F.lit(STEP)).cast("int")
    sized = sets.groupBy("cell").agg(F.sum(_bytes()).alias("cell_bytes")).join(
        sets.groupBy("cell", step.alias("step")).agg(F.sum(_bytes()).alias("step_bytes")), "cell"
    )
    whole = F.col("cell_bytes") <= BLOCK_BYTES
    sized = materialize(sized.select("cell", "step", whole.alias("whole"), F.ceil(F.col("step_bytes") / BLOCK_BYTES).alias("parts")), "steps")
    part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    block = F.when(F.col("whole"), F.xxhash64("cell")).otherwise(F.xxhash64("cell", "step", part))
    sets = materialize(sets.withColumn("step", step).join(sized, ["cell", "step"]).withColumn("block", block), "blocks")
    total = sets.agg(F.sum(_bytes())).first()[0] or 0
    links = materialize(_links_of_blocks(sets, "block", total, orders), "links")
    split = sets.where(~F.col("whole"))
    out = [links]
    if split.limit(1).count():
        out.append(materialize(_links_across(split, links, orders), "links"))
    for df in (*written[1:], sized, sets):
        discard(df)
    return out


def _links_across(sets: DataFrame, links: DataFrame, orders: Orders) -> DataFrame:
    """Links between components of cells that were joined in blocks.

    Of each cell the sets outside of its largest component are dealt anew into blocks, which meet the blocks of that
    component and each other, where their steps of size can hold similar sets.
    """
    parts_of = connected_components(links, "a", "b").select(F.col("id").alias("cid"), "component")
    rows = sets.select("cid", "cell", "step", "n").join(parts_of, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    rows = materialize(rows, "placed")
    members = rows.groupBy("cell", "component").agg(F.count("*").alias("m"))
    largest = members.groupBy("cell").agg(F.max_by("component", F.struct("m", "component")).alias("largest"))
    rows = rows.join(largest, "cell").withColumn("main", F.col("component") == F.col("largest")).drop("largest")
    # Cells that are one component are settled.
    open_cells = members.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1").select("cell")
    rows = materialize(rows.join(open_cells, "cell", "left_semi"), "placed")
    counts = rows.groupBy("cell", "main", "step").agg(F.ceil(F.sum(_bytes()) / BLOCK_BYTES).alias("parts"))
    counts = materialize(counts, "counts")
    blocks = counts.select("cell", "main", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    key = F.struct("main", "step", "part")
    blocks = blocks.withColumn("key", key)
    a, b = blocks.where(~F.col("main")).alias("a"), blocks.alias("b")
    fits = (F.col("a.cell") == F.col("b.cell")) & (F.abs(F.col("a.step") - F.col("b.step")) <= STEPS)
    once = F.col("b.main") | (F.col("a.key") <= F.col("b.key"))
    meets = a.join(b, fits & once).select(F.col("a.cell").alias("cell"), F.col("a.key").alias("one"), F.col("b.key").alias("two"))
    meets = materialize(meets.withColumn("pair", F.monotonically_increasing_id()), "meets")
    same = F.col("one") == F.col("two")
    ends = meets.select("cell", F.col("one").alias("key"), "pair", F.when(same, 2).otherwise(0).alias("side"))
    ends = ends.unionByName(meets.where(~same).select("cell", F.col("two").alias("key"), "pair", F.lit(1).alias("side")))
    place = rows.join(counts, ["cell", "main", "step"])
    part = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts"))
    place = place.select("cid", "component", "cell", F.struct("main", "step", part.alias("part")).alias("key"))
    dealt = sets.select("cid", "shingles").join(place, "cid").join(ends, ["cell", "key"]).select("pair", "side", "cid", "component", "shingles")
    shared = sets.sparkSession.sparkContext.broadcast(orders)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, side = pdf.cid.to_numpy(), pdf.side.to_numpy()
        own = [np.frombuffer(s, U) for s in pdf.shingles]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found = links_between(own, pdf.component.to_numpy(), left, right, shared.value)
        return pd.DataFrame([(ids[x], ids[y]) for x, y in found], columns=["a", "b"], dtype="int64")

    return dealt.groupBy("pair").applyInPandas(sparing_groups(run), LINKS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: rk, doc_id, n_shingles, component_id (smallest doc_id that links lead to) and component.

    component tells components apart where rows repeat a doc_id; it is null for rows without shingles.
    """
    sets = materialize(document_sets(docs), "sets")
    orders = frequent(sets)
    rows = sets.where("rk is not null").select("rk", "doc_id", "n", "s1", "s2")
    # The first row of a class stands for it; a null doc_id comes last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rk").alias("rk")))
    grouped = rows.where("n > 0").groupBy("s1", "s2").agg(first.alias("f"), F.max("n").alias("n"), F.count("*").alias("copies"))
    cid = F.monotonically_increasing_id().alias("cid")
    classes = materialize(grouped.select(cid, "s1", "s2", F.col("f.rk").alias("rk"), F.col("f.id").alias("first_id"), "n", "copies"), "classes")
    entries = classes.agg(F.sum("n")).first()[0] or 0
    found = cells(docs.select(text_or_empty().alias("text")), _sets_of_texts, orders, 0, entries)

    need = classes.join(found.select(F.col("id").alias("s1"), F.col("component").alias("cell")), "s1")
    need = materialize(need.select("rk", "cid", "s1", "cell", "copies", "n"), "need")
    sizes = materialize(need.groupBy("cell").agg(F.count("*").alias("m"), F.sum(_bytes()).alias("cell_bytes")), "cell_sizes")
    in_cells, total = need.count(), need.agg(F.sum(_bytes())).first()[0] or 0
    big = sizes.select("cell", "m", (F.col("cell_bytes") > BLOCK_BYTES).alias("big"))
    marked = materialize(join_per_key(need.drop("n"), big, ["cell"], "m", in_cells, ["cid"]).drop("m"), "marked")
    own = materialize(cell_sets(docs, marked), "cell_sets")
    links = [materialize(_links_of_blocks(_one_each(own.where(~F.col("big"))), "cell", total, orders), "links")]
    if sizes.where(F.col("cell_bytes") > BLOCK_BYTES).limit(1).count():
        large = materialize(_one_each(own.where("big")).select("cid", "cell", "n", "shingles"), "big_cells")
        links += _links_of_big_cells(large, orders)
        discard(large)
    for df in (found, need, marked, sizes, own):
        discard(df)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    parts_of = connected_components(every, "a", "b").select(F.col("id").alias("cid"), "component")

    named = classes.join(parts_of, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = materialize(named.select("s1", "s2", "component", "first_id", "copies"), "named")
    for df in (*links, classes):
        discard(df)
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_classes"))
    least = materialize(least, "least")
    named = materialize(join_per_key(named, least, ["component"], "n_classes", named.count(), ["s1"]), "named")
    named = named.select("s1", "s2", "component_id", "component", "copies")
    out = join_per_key(rows.where("n > 0"), named, ["s1", "s2"], "copies", rows.count(), ["rk"])
    none = F.lit(None).cast("bigint")
    alone = rows.where("n = 0").select("rk", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("component"))
    return out.select("rk", "doc_id", F.col("n").alias("n_shingles"), "component_id", "component").unionByName(alone)


def component_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, that come first in their component: the one with the smallest doc_id stays.

    Of rows that repeat this doc_id with other texts the one with the least key stays; rows that can't be told from it by
    doc_id and text stay with it. Rows without shingles, and components without any doc_id, keep a row each way too. A very
    long text, a null in another column, an empty table and clashing names need no care: only doc_id and text are read.
    """
    found = materialize(near_duplicates(docs).where("component is not null"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rk").alias("rk")))
    best = found.groupBy("component").agg(first.alias("f")).select(F.col("f.rk").alias("_rk")).distinct()
    gone = found.select(F.col("rk").alias("_rk")).distinct().join(best, "_rk", "left_anti")
    gone = materialize(gone, "gone")
    discard(found)
    few = broadcast_if_few(gone)
    own = free_name(docs, "_own")
    rows = docs.withColumn(own, _row_key())
    return rows.join(few, rows[own] == few["_rk"], "left_anti").drop(own)
