"""Chat formatting on tokens: segments are encoded apart, control ids spliced in, masks come from prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.lineage import cut

# Fixed: the control strings of the template. Their ids follow the vocabulary in this order.
CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|assistant|>", "</s>", "<|role|>", "<|text|>", "<|null|>")
OPEN, CLOSE = {"user": 0, "system": 2, "assistant": 4}, {"user": 1, "system": 3, "assistant": 5}
ROLE, TEXT, NULL, END = 6, 7, 8, 5
ESCAPE = "␛"
CHUNK_TURNS = 64
_ESCAPED = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_PLAIN = re.compile(ESCAPE + r"(\d)")


def escape(text: str) -> str:
    """No control string is left in the result; `unescape` restores any text."""
    return _ESCAPED.sub(lambda m: ESCAPE + str((ESCAPE, *CONTROL).index(m[0])), text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: (ESCAPE, *CONTROL)[int(m[1])], text)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer


def assemble(roles: list[str | None], texts: list[str | None], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of turns in order. The mask covers what is between an assistant's opening id and its end."""
    base = tokenizer.get_vocab_size()

    def plain(text: str) -> list[int]:
        return tokenizer.encode(escape(text), add_special_tokens=False).ids

    ids: list[int] = []
    for role, text in zip(roles, texts):
        if role in OPEN:
            ids += [base + OPEN[role], *plain(text or ""), base + CLOSE[role]]
        else:
            ids += [base + ROLE, *([base + NULL] if role is None else plain(role)), base + TEXT, *plain(text or ""), base + END]
    ids = np.array(ids, dtype=np.int32)
    opened, closed = np.cumsum(ids == base + OPEN["assistant"]), np.cumsum(ids >= base)
    ends_at = np.maximum.accumulate(np.where(ids == base + OPEN["assistant"], closed, 0))
    mask = (opened > 0) & (closed == ends_at) & (ids < base)
    return ids, mask


def render(ids, tokenizer) -> str:
    """The text of ids, control strings included."""
    base, out, run = tokenizer.get_vocab_size(), [], []
    for i in [*ids, base]:
        if i < base:
            run.append(i)
            continue
        out.append(tokenizer.decode(run, skip_special_tokens=False) if run else "")
        out.append(CONTROL[i - base])
        run = []
    return "".join(out[:-1])


def turns(ids, tokenizer) -> list[tuple[str | None, str]]:
    """(role, text) of every turn, read from ids alone."""
    base, out, role, run = tokenizer.get_vocab_size(), [], None, []
    opened = {base + v: k for k, v in OPEN.items()}
    for i in ids:
        if i < base:
            run.append(i)
            continue
        if i in opened:
            role = opened[i]
        elif i == base + TEXT:
            role = unescape(tokenizer.decode(run, skip_special_tokens=False))
        elif i == base + NULL:
            role = None
            continue
        elif i != base + ROLE:
            out.append((role, unescape(tokenizer.decode(run, skip_special_tokens=False))))
        run = []
    return out


def format_chats(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, chunk, ids, mask: the formatted conversations in chunks of 64 turn numbers, so that a long one spreads.

    Turns go by (turn, role, text), nulls first; a null text is empty, a null role has its own mark, repeated rows are
    turns of their own, a null conv_id is a conversation. The chunks of a conversation in order are its formatting.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(2**62))).cast("long"))
    ordered = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text")

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, key, roles, texts = _tokenizer(path), None, [], []

        def finished() -> pd.DataFrame:
            ids, mask = assemble(roles, texts, tokenizer)
            return pd.DataFrame({"conv_id": pd.array([key[0]], "Int64"), "chunk": [key[1]], "ids": [ids], "mask": [mask]})

        for batch in batches:
            for row in batch.astype({"conv_id": "Int64"}).itertuples(index=False):
                this = (None if row.conv_id is pd.NA else int(row.conv_id), int(row.chunk))
                if this != key:
                    if key is not None:
                        yield finished()
                    key, roles, texts = this, [], []
                roles.append(row.role)
                texts.append(row.text)
        if key is not None:
            yield finished()

    return ordered.mapInPandas(chunks, "conv_id long, chunk long, ids array<int>, mask array<boolean>")


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of stored chunks (see `format_chats`).

    Chunks are decoded apart; then each conversation's pieces pass its two digests in order, one piece at a time.
    """

    @F.pandas_udf("n_turns long, turns binary, loss string, formatted_chars long")
    def pieces(ids: pd.Series, mask: pd.Series) -> pd.DataFrame:
        tokenizer, out = _tokenizer(path), []
        for some, masked in zip(ids, mask):
            found = turns(some.tolist(), tokenizer)
            text = "".join(f"{role or ''}\n{said}\n" for role, said in found)
            loss, masked = [], np.asarray(masked, dtype=bool)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], masked.astype(np.int8), [0]))))
            for a, b in zip(edges[::2], edges[1::2]):
                loss.append(unescape(tokenizer.decode(some[a:b].tolist(), skip_special_tokens=False)))
            out.append((len(found), text.encode(), "".join(loss), len(render(some.tolist(), tokenizer))))
        return pd.DataFrame(out, columns=["n_turns", "turns", "loss", "formatted_chars"])

    rows = formatted.select("conv_id", "chunk", pieces("ids", "mask").alias("p")).select("conv_id", "chunk", "p.*")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None

        def finished() -> tuple:
            return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for row in batch.astype({"conv_id": "Int64"}).itertuples(index=False):
                this = (None if row.conv_id is pd.NA else int(row.conv_id),)
                if this != key:
                    if key is not None:
                        out.append(finished())
                    key, state = this, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += row.n_turns
                state[1].update(row.turns)
                state[2] += len(row.loss)
                state[3].update(row.loss.encode())
                state[4] += row.formatted_chars
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if key is not None:
            yield pd.DataFrame([finished()], columns=names).astype({"conv_id": "Int64"})

    return ordered.mapInPandas(totals, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_and_read(rows: DataFrame, path: str) -> DataFrame:
    return read_back(cut(format_chats(rows, path)), path)
