"""BPE encoding and decoding by dynamic programming over prefixes.

Of every prefix of a pre-token, the BPE encoding ends in one token only. An automaton over the vocabulary yields the
tokens that are suffixes of each prefix; the one that is kept is the one that may stand after the last token of what
precedes it, which a pair-compatibility test decides. Back-pointers from the end of the word then give the ids.

The vocabulary is a `tokenizers` file of the kind with word ends: lower case, NFC, white space dropped, bytes as
characters. Special tokens standing in the text get their ids, as in the library. Null and empty texts give no ids; any
length works, as the work is linear in the text. Repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batches import map_batches
from . import common

#: Runs without white space in each of the two generations of encodings that a worker keeps, and characters of a run that is kept.
KEPT_RUNS, KEPT_CHARS = 100_000, 48
#: Pairs of tokens whose test a worker remembers.
KEPT_PAIRS = 200_000
#: Characters below this have the same classes in all versions of Unicode, and none composes with another.
PLAIN_LIMIT = "ɐ"
END = "</w>"

_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\t-\r \x85\xa0]|_)+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b if b in plain else next(shifted)) for b in range(256)]


#: White space to Python, but not to the library.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self._normal, self._split = library.normalizer, library.pre_tokenizer
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self._special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._at_special = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        #: pair of ids: (rank, id of the merged token)
        self._merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self._bytes = byte_characters()
        #: Symbols are characters; one that ends a word stands 4096 higher.
        self._symbol = {}
        self._symbols: dict[int, tuple[int, ...]] = {}
        base = {t: i for t, i in vocab.items() if len(t.removesuffix(END)) == 1}
        for t, i in base.items():
            self._symbol[self._form(t)] = i
        self._automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            form = self._form(t)
            if all(c in self._symbol for c in form) and self._merged([self._symbol[c] for c in form]) == [i]:
                self._symbols[i] = tuple(self._symbol[c] for c in form)
                self._automaton.add_word(form, (i, len(form)))
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._ids, self._texts = Generations(self._encode_run, KEPT_RUNS), Generations(self._rendered, KEPT_RUNS)

    @staticmethod
    def _form(token: str) -> str:
        return token[: -len(END) - 1] + chr(ord(token[-len(END) - 1]) + 4096) if token.endswith(END) and len(token) > len(END) else token

    def _merged(self, ids: list[int]) -> list[int]:
        """Merges by rank, leftmost first: the definition, for short strings."""
        ids = list(ids)
        while len(ids) > 1:
            rank, at = min((self._merge.get(p, (1 << 60,))[0], k) for k, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self._merge[ids[at], ids[at + 1]][1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two stay as they are when encoded together."""
        pair = left << 32 | right
        if (known := self._fits.get(pair)) is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[pair] = self._merged([*self._symbols[left], *self._symbols[right]]) == [left, right]
        return known

    def encode_word(self, form: str) -> tuple[int, ...]:
        """Ids of a word in symbols."""
        last: list[int] = [-1] * (len(form) + 1)
        size: list[int] = [0] * (len(form) + 1)
        for end, (token, n) in self._automaton.iter(form):
            if last[end + 1] < 0 and (end + 1 == n or last[end + 1 - n] >= 0 and self.compatible(last[end + 1 - n], token)):
                last[end + 1], size[end + 1] = token, n
        out, at = [], len(form)
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def _encode_run(self, run: str) -> tuple[int, ...]:
        """Ids of what stands between white space: no pre-token holds any, and a run comes again more often than a text."""
        return tuple(i for word in _PLAIN.findall(run) for i in self._encode_mapped("".join([self._bytes[b] for b in word.encode()])))

    def _encode_mapped(self, chars: str) -> tuple[int, ...]:
        return self.encode_word(chars[:-1] + chr(ord(chars[-1]) + 4096))

    def _rendered(self, run: str) -> tuple[int, str, str]:
        return self._show(self._encode_run(run))

    def _show(self, ids) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _parts(self, text: str, plain: Generations, other) -> list:
        """What plain makes of each plain run, and other of the ids of each special token and any other pre-token."""
        out = []
        for part in self._at_special.split(text) if "<" in text and self._at_special else [text]:
            if part in self._special:
                out.append(other((self._special[part],)))
            elif (part.isascii() or max(part) < PLAIN_LIMIT) and not _ODD_SPACE.search(part):
                out += plain.each(part.lower().split())
            else:
                out += [other(self._encode_mapped(w)) for w, _ in self._split.pre_tokenize_str(self._normal.normalize_str(part))]
        return out

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(self._parts(text, self._ids, tuple)))

    def rendered(self, text: str) -> tuple[int, str, str]:
        """Number of ids, decimal ids joined by a space, and the decoded text."""
        parts = self._parts(text, self._texts, self._show)
        return sum([x[0] for x in parts]), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts])

    def decode(self, ids) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder; unknown ids are left out."""
        return " ".join([t for i in ids if (t := self.token.get(i)) is not None])


class Generations:
    """A bounded memory of a function of words: when the young half is full it becomes the old one, which is searched too.

    Long words aren't kept, so that the bound on words is one on bytes.
    """

    def __init__(self, make, size: int):
        self._make, self._size, self.young, self._old = make, size, {}, {}

    def new(self, word):
        if (value := self._old.get(word)) is None:
            value = self._make(word)
        if len(word) > KEPT_CHARS:
            return value
        if len(self.young) >= self._size:
            self._old, self.young = self.young, {}
        self.young[word] = value
        return value

    def each(self, runs: list[str]) -> list:
        """The values of the parts of each run. A mark after a letter is a pre-token of its own, so both are known apart."""
        young, out = self.young, []
        for r in runs:
            if (value := young.get(r)) is None:
                if len(r) > 1 and not r[-1].isalnum() and r[-2].isalpha():
                    out.append(young.get(r[:-1]) or self.new(r[:-1]))
                    r = r[-1]
                value = self.young.get(r) or self.new(r)
                young = self.young
            out.append(value)
        return out


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids array<int>."""
    return common.map_texts(df, lambda texts: [[c.encode(t) for t in texts] for c in [codec(path)]], "ids array<int>", key, text)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and decoded string of an array of ids (null: empty)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec(path).decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "decoded"])

    return map_batches(df.select(F.col(key), F.col(ids).cast("array<int>").alias(ids)), run, f"`{key}` {df.schema[key].dataType.simpleString()}, decoded string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, and digests of the decimal ids and of the decoded text: both ways in one pass over the texts."""

    def kernel(texts):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return [*map(list, zip(*((n, sha(ids), sha(back)) for n, ids, back in map(codec(path).rendered, texts)), strict=True))] or [[], [], []]

    return common.map_texts(df, kernel, "n_tokens long, ids_sha256 string, decoded_sha256 string", key, text)
