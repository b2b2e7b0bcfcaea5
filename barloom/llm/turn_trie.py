"""The trie of all conversations: what their beginnings have in common, and what sharing them saves.

Conversations become sequences of turn keys, equal sequences are put together, and the rest is dealt into ranges in the
order of the sequences. A task works its range off in shards: each gets a dictionary of its turns and a ternary search
tree of its sequences. Only the beginnings of a shard's first and last sequence can go on in another shard; they stay
open and are merged, shard by shard within a task and then 64 tasks at a time, until all nodes are complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, word_count

#: Turns in a shard, about; a longer conversation is a shard of its own.
SHARD_TURNS = 50_000
#: Tasks whose open nodes are merged at once.
FAN_IN = 64
#: Conversation ids whose difference is below a power of two are listed together.
ID_BITS = 12
#: Parts into which children of one open node are dealt.
SALT = 16

ROOT = bytes(16)
NOTHING = hashlib.sha256().hexdigest()
NODE = "done boolean, task int, key binary, parent binary, depth long, words long, members long, least long, ends string, children long, leaves long, saved long, first boolean, last boolean, opened boolean, parent_least long"
_ARROW = pa.schema([("done", pa.bool_()), ("task", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), *((n, pa.int64()) for n in ("depth", "words", "members", "least")), ("ends", pa.string()), *((n, pa.int64()) for n in ("children", "leaves", "saved")), ("first", pa.bool_()), ("last", pa.bool_()), ("opened", pa.bool_()), ("parent_least", pa.int64())])


def turn_key(role: Column, text: Column) -> Column:
    """Hexadecimal MD5 of a turn's role and text; the length of the role keeps them apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation c with the first crc32(c) % 4 turns of conversation c - c % 20 in place of its own.

    Turns go by number, null first, those of equal number by their keys; a null role or text is empty; rows that repeat
    are turns of their own; rows without conv_id belong to no conversation. A turn is (key, words). Texts stay where they
    are read; of each turn a row of fixed size is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    number = F.col("turn").cast("long")
    turn = F.struct(number.isNotNull().alias("numbered"), F.coalesce(number, F.lit(0)).alias("number"), turn_key(role, text).alias("key"), word_count(text).cast("long").alias("words"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).where("conv_id is not null")
    plain = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    own = rows.groupBy("conv_id").agg(plain.alias("own"))
    base = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base_id"), F.slice("own", 1, 3).alias("base"))
    joined = own.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % 20).join(base, "base_id", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    none = F.slice("own", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("base", none), F.lit(1), h), F.slice("own", h + 1, F.size("own"))).alias("turns"))


def _record(key: bytes, parent: bytes, depth: int, words: int) -> dict:
    return {"key": key, "parent": parent, "depth": depth, "words": words, "members": 0, "least": None, "ends": NOTHING, "children": 0, "leaves": 0, "saved": 0, "first": False, "last": False, "opened": False}


def _median_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


def search_tree(sequences: list[tuple[list[bytes], list[int], int, int, str]]) -> list[dict]:
    """Nodes of sorted distinct sequences (keys, words, members, least conv_id, hash of ends), children after their parents.

    A ternary search tree over the numbers of the sequences' turns in the shard's dictionary; the middle sequence goes in
    first, then those of the halves, so that siblings lie in balanced trees.
    """
    number = {k: i for i, k in enumerate(sorted({k for keys, *_ in sequences for k in keys}))}
    nodes = [_record(ROOT, ROOT, 0, 0)]
    up, symbol, low, high, down = [-1], [-1], [-1], [-1], [-1]
    for s in _median_first(len(sequences)):
        keys, words, members, least, ends = sequences[s]
        at = 0
        for depth, (k, w) in enumerate(zip(keys, words), 1):
            mine, here, link, of = number[k], down[at], down, at
            while here >= 0 and symbol[here] != mine:
                link, of = (low, here) if mine < symbol[here] else (high, here)
                here = link[of]
            if here < 0:
                here = link[of] = len(nodes)
                nodes.append(_record(hashlib.md5(nodes[at]["key"] + k).digest(), nodes[at]["key"], depth, w))
                for column, value in ((up, at), (symbol, mine), (low, -1), (high, -1), (down, -1)):
                    column.append(value)
            at = here
            if s in (0, len(sequences) - 1):
                nodes[at]["first"] |= s == 0
                nodes[at]["last"] |= s == len(sequences) - 1
        nodes[at].update(members=members, least=least, ends=ends)
    nodes[0]["first"] = nodes[0]["last"] = True
    for i in range(len(nodes) - 1, 0, -1):
        mine, parent = nodes[i], nodes[up[i]]
        parent["members"] += mine["members"]
        parent["least"] = mine["least"] if parent["least"] is None else min(parent["least"], mine["least"])
    return nodes


def settle(parts: list[Iterable[dict]], whole: bool = False) -> tuple[list[dict], list[dict]]:
    """(complete nodes, open nodes) of neighbouring parts in order; with `whole` there are no other parts and all become complete.

    Open are the beginnings of the first part's first sequence and of the last part's last one. A complete node hands
    its leaves and savings to its parent; parent_least is the parent's smallest member, null while the parent is open.
    """
    merged: dict[bytes, dict] = {}
    for i, part in enumerate(parts):
        for node in part:
            first, last = node["first"] and i == 0, node["last"] and i == len(parts) - 1
            old = merged.get(node["key"])
            if old is None:
                merged[node["key"]] = {**node, "first": first, "last": last}
                continue
            for name in ("members", "children", "leaves", "saved"):
                old[name] += node[name]
            old["least"] = min(old["least"], node["least"])
            old["ends"] = node["ends"] if old["ends"] == NOTHING else old["ends"]
            old["first"], old["last"], old["opened"] = old["first"] or first, old["last"] or last, old["opened"] or node["opened"]
    done, still = [], []
    for node in sorted(merged.values(), key=lambda n: -n["depth"]):
        if not whole and (node["first"] or node["last"]):
            node["opened"] = True
            still.append(node)
            continue
        node["leaves"] += node["children"] == 0
        node["saved"] += (node["members"] - 1) * node["words"]
        node["parent_least"] = None
        if node["depth"]:
            parent = merged[node["parent"]]
            parent["children"] += 1
            parent["leaves"] += node["leaves"]
            parent["saved"] += node["saved"]
            if whole or not (parent["first"] or parent["last"]):
                node["parent_least"] = parent["least"]
        done.append(node)
    return done, still


def _rows(nodes: list[dict], done: bool, task: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{**n, "done": done, "task": task} for n in nodes], schema=_ARROW)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int], int, int, str]]:
    """Equal sequences put together: rows come by sequence and block of ids, so their ids are hashed in order as they come."""
    now = None
    for batch in batches:
        for seq, words, members, least, ids in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("seq", "words", "members", "least", "ids"))):
            seq = seq.as_py()
            if now is not None and now[0] == seq:
                now[2] += members.as_py()
                now[3] = min(now[3], least.as_py())
                now[4].update(b"," + ids.as_py().encode())
                continue
            if now is not None:
                yield [now[0][i : i + 16] for i in range(0, len(now[0]), 16)], now[1], now[2], now[3], now[4].hexdigest()
            now = [seq, words.as_py(), members.as_py(), least.as_py(), hashlib.sha256(ids.as_py().encode())]
    if now is not None:
        yield [now[0][i : i + 16] for i in range(0, len(now[0]), 16)], now[1], now[2], now[3], now[4].hexdigest()


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list]:
    held, turns = [], 0
    for sequence in _sequences(batches):
        held.append(sequence)
        turns += len(sequence[0]) + 1
        if turns >= size:
            yield held
            held, turns = [], 0
    if held:
        yield held


def _of_range(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Complete nodes of a task's range, shard by shard, and those still open at its end."""
    task, carried = TaskContext.get().partitionId(), None
    for shard in _shards(batches, size):
        done, still = settle([search_tree(shard)])
        if carried is not None:
            more, still = settle([carried, still])
            done += more
        carried = still
        yield _rows(done, True, task)
    if carried is not None:
        yield _rows(carried, False, task)


def _merge(group: pa.Table, fan_in: int, whole: bool) -> pa.Table:
    """Open nodes of neighbouring tasks merged; rows of what is now complete and of what is open still."""
    parts: dict[int, list[dict]] = {}
    for row in group.to_pylist():
        parts.setdefault(row["task"], []).append(row)
    done, still = settle([parts[t] for t in sorted(parts)], whole)
    at = min(parts) // fan_in
    return pa.Table.from_batches([_rows(done, True, at), _rows(still, False, at)])


def _merger(fan_in: int, whole: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda group: _merge(group, fan_in, whole)


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan_in: int = FAN_IN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node, for rebuilt conversations (conv_id, turns).

    conv_id is the node's smallest member, which with the depth names it. An empty table has no node. Equal sequences
    are counted before they are shuffled by their order; their ids travel in blocks of 2**ID_BITS, and one task hashes
    those of one sequence, as SHA-256 goes through them in order, holding a block at a time. A conversation's own turns
    are one row.
    """
    keyed = conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"), F.shiftright("conv_id", ID_BITS).alias("block"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",")
    blocks = cut(keyed.groupBy("seq", "block").agg(F.any_value("words").alias("words"), F.count("*").alias("members"), F.min("conv_id").alias("least"), ids.alias("ids")))
    nodes = cut(blocks.repartitionByRange("seq").sortWithinPartitions("seq", "block").mapInArrow(lambda batches: _of_range(batches, shard_turns), NODE))
    done, still = nodes.where("done"), nodes.where("not done")
    tasks = (still.agg(F.max("task")).first()[0] or 0) + 1  # one number
    while True:
        tasks = -(-tasks // fan_in)
        whole = tasks == 1
        merged = cut(still.groupBy(F.expr(f"task div {fan_in}")).applyInArrow(_merger(fan_in, whole), NODE))
        done, still = done.unionByName(merged.where("done")), merged.where("not done")
        if whole:
            break
    # Nodes that were complete before their parents find them by key; the parents are few, so each stands in every part.
    parents = done.where("opened").select(F.col("key").alias("parent"), F.col("least").alias("found"), F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    children = done.withColumn("salt", F.when((F.col("depth") > 0) & F.col("parent_least").isNull(), F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")))
    return children.join(parents, ["parent", "salt"], "left").select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_least", "found")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
