"""Chat formatting: token-level assembly.

Each turn's text is encoded by itself, as ordinary text, and reserved ids are spliced around
it, so no token spans a turn's border and no text can produce a reserved id:

    conversation, { role, ids of the text ..., end } for each turn

The loss mask is 1 for an assistant's ids and its end.  It is the prefix sum of +1 where a
trained stretch begins and -1 after it ends.  Control strings in a text, such as <|user|>,
are escaped by a backslash (<\\|user|>), one more if there are some already, so the decoded
text of a turn can be told from control and unescape() gives the original back.

The tokenizer file is a parameter; nothing is trained.  The reserved ids are those after its
vocabulary.  Turns are encoded where they are, and their ids move once, by conversation.

Defined cases: turns are ordered by turn (null first), then role, then ids, so ties and
repeated rows keep a place each; a null or unknown role gets the id of `other`; a null text
is an empty one, of no ids; a very long text is encoded whole; what conversation a row of null
conv_id is of isn't known, so each is one of its own; a conversation of more than TURNS turns
has a row for each TURNS of them, numbered by part, of which the first begins with the
conversation's id, so no task holds more than these; an empty table gives no rows.  Other
columns are neither read nor returned.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.tokens import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURNS = 4096
CONTROL = ("conversation", "system", "user", "assistant", "other", "end")
_WORDS = "|".join([*CONTROL, "endoftext"])
_ESCAPE, _UNESCAPE = re.compile(rf"<(\\*)\|({_WORDS})\|>"), re.compile(rf"<\\(\\*)\|({_WORDS})\|>")
SCHEMA = "conv_id long, part int, tokens array<int>, mask array<int>, n_turns int, n_trained int"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|\2|>", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|\2|>", text)


@lru_cache(1)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(1)
def ids(path: str) -> dict[str, int]:
    """The reserved ids: the first that the vocabulary leaves free."""
    t = tokenizer(path)
    first = max(t.get_vocab(True).values(), default=-1) + 1
    return {name: first + k for k, name in enumerate(CONTROL)}


def assemble(whole: np.ndarray, head: np.ndarray, roles: list[str | None], n: np.ndarray, flat: np.ndarray, named: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and mask of all rows end to end, and the offset of each.

    whole: the first turn of each row; head: whether a turn begins a conversation; n: each
    turn's number of ids, which flat holds end to end.
    """
    head = head.astype(np.int64)
    size = n + 2 + head
    stop = np.cumsum(size)
    start = stop - size
    tokens = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
    tokens[start[head > 0]] = named["conversation"]
    tokens[start + head] = [named[r] if r in ("system", "user", "assistant") else named["other"] for r in roles]
    tokens[stop - 1] = named["end"]
    place = np.repeat(start + head + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    tokens[place] = flat
    trained = np.array([r == "assistant" for r in roles], bool)
    edge = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(edge, (start + head + 1)[trained], 1)
    np.add.at(edge, stop[trained], -1)
    return tokens, np.cumsum(edge[:-1], dtype=np.int32), np.r_[start[whole], len(tokens)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        encode = getattr(t, "encode_batch_fast", t.encode_batch)  # without offsets, where there is such a one
        for batch in batches:
            for part in slices(batch):
                for lo in range(0, part.num_rows, 500):
                    some = part.slice(lo, 500)
                    got = [e.ids for e in encode([escape(x or "") for x in some.column(3).to_pylist()], add_special_tokens=False)]
                    off = np.zeros(len(got) + 1, np.int32)
                    np.cumsum([len(x) for x in got], out=off[1:])
                    flat = np.fromiter(chain.from_iterable(got), np.int32, off[-1])
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["conv_id", "turn", "role", "ids"])

    return run


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, held = ids(path), None  # turns of the row that isn't out yet

        def out(turns: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            turns = turns.combine_chunks()
            conv, part, role, listed = (c.chunk(0) for c in turns.select(["conv_id", "part", "role", "ids"]).columns)
            head = np.zeros(len(role), bool)
            head[first] = np.asarray(part)[first] == 0
            n = np.diff(np.asarray(listed.offsets)).astype(np.int64)
            tokens, mask, off = assemble(first, head, role.to_pylist(), n, np.asarray(listed.flatten()), named)
            lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x)) for x in (tokens, mask)]
            count = np.diff(np.r_[first, len(role)]).astype(np.int32)
            trained = np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][off]).astype(np.int32)
            at = pa.array(first)
            return pa.RecordBatch.from_arrays([conv.take(at), part.take(at), *lists, pa.array(count), pa.array(trained)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            if not now.num_rows:
                continue
            key, part = np.asarray(now.column("key")), np.asarray(now.column("part"))
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            if len(first) > 1:
                yield out(now.slice(0, int(first[-1])), first[:-1])
            held = now.slice(int(first[-1]))
        if held is not None and held.num_rows:
            yield out(held, np.zeros(1, np.int64))

    return run


def format_chats(spark: SparkSession, conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """conv_id, part, tokens, mask, n_turns, n_trained of each conversation."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    known, unknown = (turns.where(f"conv_id IS {x} NULL").mapInArrow(_encode(path), "conv_id long, turn long, role string, ids array<int>") for x in ("NOT", ""))
    known = known.withColumn("key", F.col("conv_id"))
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "ids")
    known = known.withColumn("part", F.floor((F.row_number().over(order) - 1) / TURNS).cast("int")).select("key", "part", "conv_id", "role", "ids")
    unknown = unknown.select(F.monotonically_increasing_id().alias("key"), F.lit(0).alias("part"), "conv_id", "role", "ids")
    return known.mapInArrow(_format(path), SCHEMA).unionByName(unknown.mapInArrow(_format(path), SCHEMA))
