"""Chat rows, rendered prompts, label masks, token budgets, task mixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, words
from .sampling import SEED, draw
from .templates import CURRICULUM

IGNORED = -100  # label of tokens that training does not predict
PIECE = 1 << 20  # characters whose ids are held at once, beside one conversation's


def message(role: str, text) -> Column:
    return F.struct(F.lit(role).alias("role"), col(text).alias("content"))


def prompt_completion(df: DataFrame, prompt: str, completion: str, training: bool = True, prompt_type: str = "chat") -> DataFrame:
    """df with prompt and completion: lists of messages, the completion empty in evaluation; or plain strings."""
    if prompt_type == "chat":
        none = F.expr("cast(array() as array<struct<role: string, content: string>>)")
        done = F.array(message("assistant", completion)) if training else none
        return df.withColumns({"prompt": F.array(message("user", prompt)), "completion": done})
    if prompt_type == "instruction":
        return df.withColumns({"prompt": instruction(prompt), "completion": F.col(completion) if training else F.lit("")})
    raise ValueError(f"unknown prompt type: {prompt_type}")


def instruction(c) -> Column:
    return F.concat(F.lit("###Input:\n"), col(c), F.lit("\n\n###Output:\n"))


def messages(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, messages) in turn order; a conversation is one row, as long as it is."""
    own = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(conversation).agg(F.transform(own, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chatml(messages_: Column | str, generate: bool = False) -> Column:
    """Messages between start and end marks, one after the other."""
    parts = F.transform(col(messages_), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generate else text


def tagged(messages_: Column | str, end: str = "</s>", generate: bool = False) -> Column:
    """Messages of known roles under role tags."""
    known = F.filter(col(messages_), lambda m: m["role"].isin("user", "system", "assistant"))
    parts = F.transform(known, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(end), F.lit("\n")))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit("<|assistant|>")) if generate else text


def label_mask(prompt_ids: Column, full_ids: Column, longest: int) -> Column:
    """The full ids with the prompt's part ignored, cut to the longest length.

    A prompt that is longer than the full ids, as a template may make it, leaves no label.
    """
    p = F.least(F.size(prompt_ids), F.size(full_ids))
    own = F.concat(F.array_repeat(F.lit(IGNORED), p), F.slice(full_ids, p + 1, F.size(full_ids)))
    return F.slice(own, 1, longest)


def tokenised(df: DataFrame, prompt: str, full: str, tokenizer=None, longest: int = 2048) -> DataFrame:
    """df with input_ids, attention_mask, labels. tokenizer: a function of a list of texts to lists of ids; white-space words hashed to 31 bits by default."""
    if tokenizer is None:
        ids = lambda c: F.transform(words(c), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))
        p, f = ids(F.col(prompt)), ids(F.col(full))
        rows = df.withColumns({"_p": p, "_f": f})
    else:

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series(tokenizer(texts.fillna("").tolist()), index=texts.index)

        rows = df.withColumns({"_p": encode(prompt), "_f": encode(full)})
    cut = F.slice("_f", 1, longest)
    return rows.withColumns({"input_ids": cut, "attention_mask": F.transform(cut, lambda _: F.lit(1)), "labels": label_mask(F.col("_p"), F.col("_f"), longest)}).drop("_p", "_f")


def token_budget(df: DataFrame, text: str, encode, decode, longest: int = 4096, new_tokens: int = 512, margin: int = 100) -> DataFrame:
    """df with text cut to the ids that leave room for new ones. encode, decode: functions of lists, texts to ids and back."""
    room = longest - new_tokens - margin
    if room <= 0:
        raise ValueError("no room is left for the input")

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = texts.copy()
        some = texts[texts.notna()]
        long = {k: ids[:room] for k, ids in zip(some.index, encode(some.tolist()), strict=True) if len(ids) > room}
        if long:
            out[list(long)] = decode(list(long.values()))
        return out

    return df.withColumn(text, cut(text))


def budget(c, longest: int, new_tokens: int, margin: int = 100) -> Column:
    """The first words that leave room for new ones."""
    room = longest - new_tokens - margin
    if room <= 0:
        raise ValueError("no room is left for the input")
    own = words(c)
    return F.when(F.size(own) > room, F.array_join(F.slice(own, 1, room), " ")).otherwise(col(c))


def mix(tasks: dict[str, DataFrame], key: str, order: str = "random", seed: int = SEED, curriculum: list[str] = CURRICULUM) -> DataFrame:
    """All tasks' rows with task, task_no and mix_key: sorting by (task_no, mix_key) is the training order.

    random: one seeded shuffle over all (task_no 0); curriculum: task by task, known tasks
    first, seeded within each. The order is a key, not a sorted table.
    """
    if order not in ("random", "curriculum"):
        raise ValueError(f"unknown order: {order}")
    names = [t for t in curriculum if t in tasks] + sorted(t for t in tasks if t not in curriculum)
    parts = [tasks[t].withColumns({"task": F.lit(t), "task_no": F.lit(names.index(t) if order == "curriculum" else 0)}) for t in names]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.withColumn("mix_key", draw(key, seed, F.col("task")))


_OPEN, _CLOSE = "<|im_start|>\n", "<|im_end|>\n"  # what stands around a message's role and content


def labelled(df: DataFrame, messages_: str, tokenizer: str, longest: int | None = None, role: str = "assistant") -> DataFrame:
    """df with input_ids and labels: the ids of the whole rendered conversation, and of these the ones that lie within
    what the role says, the others ignored.

    tokenizer: the path of a tokenizer's file, loaded once a worker. Ids are aligned by the characters they stand for:
    one that reaches over the edge of a turn is ignored, and every turn of the role is learnt, however many there are.
    Null roles and contents are empty; a null list has no ids. longest: ids that are kept.
    """
    whole = F.transform(F.col(messages_), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    # a rendered message is mark, role, newline, content, end mark
    turns = F.transform("_m", lambda m: F.struct((m["role"] == role).alias("own"), F.length(m["role"]).alias("role"), F.length(m["content"]).alias("content")))
    rows = df.withColumn("_m", whole).withColumns({"_t": chatml("_m"), "_s": turns})

    def encoded(texts: pd.Series, messages: pd.Series) -> pd.DataFrame:
        ids, labels = [], []
        for text, turns in zip(texts, messages, strict=True):
            if text is None:
                ids.append(None)
                labels.append(None)
                continue
            got = _tokenizer(tokenizer).encode(text, add_special_tokens=False)
            at = np.array(got.offsets, np.int64).reshape(-1, 2)
            own, said, held = (np.array([s[k] for s in turns], np.int64) for k in ("own", "role", "content"))
            whole = said + held + len(_OPEN) + len(_CLOSE)
            ends = np.cumsum(whole)
            edges = np.stack([ends - whole + len(_OPEN) + said, ends], axis=1)[own > 0]
            turn = np.searchsorted(edges[:, 0], at[:, 0], "right") - 1
            inside = (turn >= 0) & (at[:, 1] <= edges[np.maximum(turn, 0), 1]) if len(edges) else np.zeros(len(at), bool)
            own_ids = np.array(got.ids, np.int32)
            ids.append(own_ids[:longest])
            labels.append(np.where(inside, own_ids, np.int32(IGNORED))[:longest])
        return pd.DataFrame({"input_ids": pd.Series(ids, dtype=object), "labels": pd.Series(labels, dtype=object)})

    @F.pandas_udf("input_ids array<int>, labels array<int>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # a batch is so many rows however long they are; their ids are handed back piece by piece
        for texts, messages in batches:
            begins = np.cumsum(texts.str.len().fillna(0)).to_numpy() // PIECE
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(begins)) + 1):
                yield encoded(texts.iloc[own], messages.iloc[own])

    return rows.withColumn("_e", encode("_t", "_s")).withColumns({"input_ids": F.col("_e.input_ids"), "labels": F.col("_e.labels")}).drop("_m", "_t", "_s", "_e")


_LOADED: dict = {}
_EDGES: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _edge(t) -> int | None:
    """Characters before a cut that may turn out otherwise than in the whole text; None where that isn't known.

    Splits of a ByteLevel tokenizer look at two characters after them at most, and at the tokens that were added.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    added = t.get_added_tokens_decoder().values()
    plain = t.normalizer is None and t.truncation is None and isinstance(t.pre_tokenizer, ByteLevel) and t.pre_tokenizer.use_regex
    if not plain or any(x.lstrip or x.rstrip or x.single_word for x in added):
        return None
    return 2 + max((len(x.content) for x in added), default=0)


def first_offsets(tokenizer: str, text: str, n: int) -> list[tuple[int, int]]:
    """Offsets of a text's first ids, n of them at least if it has so many; the rest of a long text is not encoded."""
    t = _tokenizer(tokenizer)
    if tokenizer not in _EDGES:
        _EDGES[tokenizer] = _edge(t)
    edge, size = _EDGES[tokenizer], 8 * n + 64
    while edge is not None and size < len(text):
        got = t.encode(text[:size], add_special_tokens=False)
        at, words = got.offsets, got.word_ids
        # the first split that comes near the cut, from which on ids may be others
        near = next((words[k] for k, (_, end) in enumerate(at) if end > size - edge), None)
        if len(at) >= n and near is not None and words[n - 1] < near:
            return at[:n]
        size *= 4
    return t.encode(text, add_special_tokens=False).offsets


def within_budget(df: DataFrame, text: str, tokenizer: str, longest: int = 4096, new_tokens: int = 512, margin: int = 100) -> DataFrame:
    """df with text cut after the last whole character of the ids that leave room for new ones; what fits stays as it is."""
    room = longest - new_tokens - margin
    if room <= 0:
        raise ValueError("no room is left for the input")

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            at = None if x is None else first_offsets(tokenizer, x, room + 1)
            if at is None or len(at) <= room:
                out.append(x)
            else:
                # a character whose bytes are not all among the ids that stay goes too
                end, after = at[room - 1][1], at[room][0]
                out.append(x[: min(end, after)])
        return pd.Series(out, index=texts.index, dtype=object)

    return df.withColumn(text, cut(text))
