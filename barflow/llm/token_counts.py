"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is proven or not to encode alone as one token: it must be
a single pre-token and the tokenizer must give one id for it. Counting then splits a text
into pre-tokens, counts those in the proven set as one token at sight, and merges only
the rest with the tokenizer's own merges, each distinct one once per worker.

Why it is exact: a pre-token is encoded on its own, so its count does not depend on its
neighbours; special strings are cut out first, as the library does. Texts with characters
that Unicode versions may class differently go to the library whole (see ``pretokens``).

Edge cases: null counts as the empty text (0 bytes, 0 tokens); texts are never cut; rows
are independent, so repeated rows and any order give the same counts; extra columns pass
through, except that ``n_bytes`` and ``n_tokens`` are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretokens import byte_level, chunks, classes

#: Distinct merged pre-tokens that a worker remembers; at the limit it starts anew.
MEMO_LIMIT = 1_000_000
_state: dict[str, tuple] = {}


def prove_whole_tokens(tokenizer) -> set[str]:
    """Vocabulary strings (decoded) that encode alone as exactly one token."""
    split = byte_level()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = tokenizer.decode_batch([[i] for i in sorted(tokenizer.get_vocab().values())], skip_special_tokens=False)
    texts = [t for t in texts if t and t not in special and "�" not in t and split.findall(t) == [t]]
    return {t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1}


def proven(source: bytes) -> tuple[bytes, frozenset[str]]:
    """A tokenizer file's bytes and the strings that it encodes as one token: made once, before any counting."""
    from tokenizers import Tokenizer

    return source, frozenset(prove_whole_tokens(Tokenizer.from_buffer(source)))


def _load(source: bytes, whole: frozenset[str]):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(source)
    if key not in _state:
        tok = Tokenizer.from_buffer(source)
        _state.clear()
        _state[key] = (tok, dict.fromkeys(whole, 1), [t.content for t in tok.get_added_tokens_decoder().values()])
    return _state[key]


def count_texts(proof: tuple[bytes, frozenset[str]], texts: list[str]) -> list[int]:
    """Tokens of each text, for a byte-level BPE in the tokenizers' JSON form, as ``proven``."""
    tok, memo, special = _load(*proof)
    firsts = {s[0] for s in special}
    odd, split = classes()[2], byte_level()
    out = []
    for a, b in chunks(texts):
        if len(memo) > MEMO_LIMIT:
            memo.clear()
            memo.update(dict.fromkeys(proof[1], 1))
        parts: list = []
        for t in texts[a:b]:
            n, pieces = 0, [t]
            if odd.search(t):
                n, pieces = len(tok.encode(t, add_special_tokens=False).ids), []
            elif any(c in t for c in firsts):
                for s in special:
                    pieces = [y for x in pieces for y in x.split(s)]
                n = len(pieces) - 1
            parts.append((n, [split.findall(x) for x in pieces]))
        rest = set().union(*(x for _, p in parts for x in p)) - memo.keys()
        rest = list(rest)
        for w, e in zip(rest, tok.encode_batch(rest, add_special_tokens=False)):
            memo[w] = len(e.ids)
        out += [n + sum(sum(map(memo.__getitem__, x)) for x in p) for n, p in parts]
    return out


def token_counter(spark, path: str) -> Column:
    """A function of a text column giving its number of tokens (long)."""
    with open(path, "rb") as f:  # a vocabulary file: its size is fixed, about 2 MB
        proof = spark.sparkContext.broadcast(proven(f.read()))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(count_texts(proof.value, s.tolist()), dtype="int64")

    return count


def count_tokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_bytes (UTF-8) and n_tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = token_counter(df.sparkSession, path)
    return df.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": count(text)})


def token_count_query(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    out = count_tokens(docs.select("doc_id", "text"), path)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
