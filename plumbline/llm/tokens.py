"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is encoded alone: those that give one token are proven whole. A text is split
into pre-tokens by the tokenizer's own pattern; a whole one counts as one token, the rest are merged by the library,
each distinct one once. Equal to encoding the whole text, as merges never cross pre-tokens and each pre-token is its
own only pre-token when it stands alone.

That holds for byte-level tokenizers of one known pattern, without a normaliser and with plain special strings: a file
is looked into first, and texts of any other (a SentencePiece model too) are encoded whole by its library.

Defined cases: null texts count as empty (0 tokens); special strings in a text count as the library counts them by
default; texts are read whole; equal rows get equal counts; extra columns are ignored; ids may be of any type.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dealing import dealt

LIMIT = 512
#: The byte-level pattern of this family of tokenizers (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points up to here have classes of their own below, made by their Unicode categories; PATTERN over them is then a
#: pattern of the standard library's matcher, which is faster.
NEAR = 0x250
#: Distinct pre-tokens that a task remembers, and the longest of them.
MEMORY, LONGEST = 200_000, 64
#: Documents whose pre-tokens are held at once.
DOCUMENTS = 32


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def splits_by_pattern(path: str) -> bool:
    """Whether the file's tokenizer is of the kind that PATTERN stands for."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(t.get(x) for t in spec.get("added_tokens") or [] for x in ("lstrip", "rstrip", "single_word", "normalized"))
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(level and plain and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))


def whole_tokens(path: str) -> list[str]:
    """The strings of the vocabulary that encode alone as one token: at most as many as the vocabulary has."""
    t = load(path)
    size = t.get_vocab_size(with_added_tokens=False)
    strings = [t.decode([i], skip_special_tokens=False) for i in range(size)]
    return sorted({s for s, e in zip(strings, t.encode_batch(strings, add_special_tokens=False), strict=True) if s and len(e.ids) == 1})


def near_pattern() -> str:
    """PATTERN for texts of code points below NEAR, classes written out."""
    of = lambda k: "".join(re.escape(chr(c)) for c in range(NEAR) if unicodedata.category(chr(c))[0] == k)
    letter, number, space = of("L"), of("N"), r"\t\n\v\f\r \x85\xa0"
    out = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return out.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


class Counter:
    """Counts tokens of texts; one for each worker process."""

    def __init__(self, path: str, whole: list[str]):
        import regex

        self.t, self.whole = load(path), whole
        self.far, self.find_near, self.find_far = re.compile(f"[^\x00-{chr(NEAR - 1)}]").search, re.compile(near_pattern()).findall, regex.compile(PATTERN).findall
        special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else None
        self.special = special
        self.known = dict.fromkeys(whole, 1)

    def find(self, text: str) -> list[str]:
        return self.find_near(text) if self.far(text) is None else self.find_far(text)

    def count(self, texts: list[str]) -> list[int]:
        pieces, out = [], []
        for text in texts:
            parts = self.split(text) if self.split and any(s in text for s in self.special) else [text]
            out.append(len(parts) - 1)
            pieces.append([x for p in parts for x in self.find(p)] if len(parts) > 1 else self.find(text))
        if len(self.known) > MEMORY:
            self.known = dict.fromkeys(self.whole, 1)
        known = self.known
        rest = list({x for p in pieces for x in p if x not in known})
        rare = {}
        for a in range(0, len(rest), 4096):
            for s, e in zip(rest[a : a + 4096], self.t.encode_batch(rest[a : a + 4096], add_special_tokens=False), strict=True):
                (known if len(s) <= LONGEST else rare)[s] = len(e.ids)
        for i, p in enumerate(pieces):
            try:
                out[i] += sum(map(known.__getitem__, p))
            except KeyError:
                out[i] += sum(known[x] if x in known else rare[x] for x in p)
        return out


class Library:
    """Counts by the library alone, whole texts."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in model.encode(texts)]
        else:
            t = load(path)
            self.count = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


_counters: dict[str, Counter | Library] = {}


def counter_of(path: str, shared) -> Counter | Library:
    """The worker's own counter: the library's model is loaded once, not for every task."""
    if path not in _counters:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[path] = Library(path) if shared is None else Counter(path, shared.value)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each document; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(path)) if splits_by_pattern(path) else None  # bounded by the vocabulary

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(path, shared)
        for texts in batches:
            counts = []
            for a in range(0, len(texts), DOCUMENTS):
                counts += counter.count(texts.iloc[a : a + DOCUMENTS].tolist())
            yield pd.Series(counts, dtype="int64")

    t = F.coalesce(F.col(text_col), F.lit(""))
    d = dealt(docs.select(id_col, text_col)).select(F.col(id_col), F.octet_length(t).cast("bigint").alias("n_bytes"), tokens(t).alias("n_tokens"))
    return d.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
