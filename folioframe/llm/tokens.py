"""Tokenizing with the tokenizers library, and token counts attributed to sections by character offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import long_rows, mix64, table

#: A blank alone between other characters. The byte-level tokenizer always cuts before it: no alternative of its
#: pattern runs from another character into white space, and each takes one blank before what follows.
SEAM = re.compile(r"(?<![\s\u180e\u200b\ufeff]) (?![\s\u180e\u200b\ufeff])")
#: White space, or what could count as such, beyond ASCII.
WIDE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Chunks of text that a worker remembers, and characters of text handled at once; both bound memory, not results.
REMEMBERED, RECENT, AT_ONCE = 600_000, 100_000, 1 << 18
#: Bytes of the longest chunk that is remembered.
LONGEST = 64
#: Rows of an Arrow batch that become Python objects together.
AT_A_TIME = 256
DEFAULT = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)


#: The bytes of a 64-bit word that count, for 0 to 8 of them.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def _differ(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> bool:
    """Whether some stretch a[at:at + size] is not b[bt:bt + size]; eight more bytes follow in either."""
    a, b = _words(a), _words(b)
    for k in range(0, int(size.max(initial=0)), 8):
        if k:
            on = np.flatnonzero(size > k)
            at, bt, size_ = at0[on] + k, bt0[on] + k, size[on] - k
        else:
            at0, bt0, size_ = at, bt, size
        if ((a[at] ^ b[bt]) & _MASK[np.minimum(size_, 8)]).any():
            return True
    return False


class Known:
    """ids by chunk: sorted 64-bit hashes, each with the place and number of its bytes, by which a hit is verified, and
    of its ids in a pool. New chunks gather in a short run that is merged into the long one now and then."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int16)
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.text_at, self.text_size = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each ascending key, -1 for unknown ones."""
        out = np.full(len(keys), -1)
        for known, entry in self.runs:
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[place] == keys, entry[place], out)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """Entries for new keys, whose ids follow each other."""
        if len(self.at) + len(keys) > REMEMBERED:
            raise MemoryError
        text, long = np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int64, len(chunks))
        while self.text_used + len(text) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(len(self.text) // 2, np.uint8)])
        self.text[self.text_used:self.text_used + len(text)] = text
        self.text_at = np.concatenate([self.text_at, (self.text_used + np.cumsum(long) - long).astype(np.int32)])
        self.text_size = np.concatenate([self.text_size, long.astype(np.uint8)])
        self.text_used += len(text)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2, self.dtype)])
        self.pool[self.used:self.used + len(ids)] = ids
        entry = (len(self.at) + np.arange(len(keys))).astype(np.int32)
        self.at = np.concatenate([self.at, (self.used + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes.astype(np.int16)])
        self.used += len(ids)
        self.runs[1] = self._merged(self.runs[1], (keys, entry))
        if len(self.runs[1][0]) > RECENT:
            self.runs = [self._merged(*self.runs), (keys[:0], entry[:0])]
        return entry

    @staticmethod
    def _merged(a, b):
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]


class Encoder:
    """Whole texts to ids, as little-endian bytes of `dtype`.

    A byte-level tokenizer cuts a text before each SEAM and never merges over a cut. Where every blank is a seam, the
    library encodes each different chunk between blanks once, and a text's ids are those of its chunks, in order:
    what the library returns for the whole text. All other texts it gets whole."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        state = json.loads(self.tokenizer.to_str())
        pre = state.get("pre_tokenizer") or {}
        added = state.get("added_tokens") or []
        #: Texts with one of these are cut there first; the library gets them whole.
        self.added = [x["content"] for x in added]
        plain = not any(x.get("lstrip") or x.get("rstrip") or any(map(str.isspace, x["content"])) for x in added)
        self.cuts = plain and state.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.size = self.byte_lengths() if self.cuts else None
        self.known = Known(self.dtype)
        self.power = self.back = np.ones(1, np.uint64)

    def _plainly(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > AT_ONCE and (m := SEAM.search(text, at + AT_ONCE // 2)):
            if m.start() == at + AT_ONCE // 2:  # the search did not see what stands before
                m = SEAM.search(text, m.end()) or m
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.back = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n + n // 4, b, np.uint64)])) for b in (_BASE, _INVERSE))

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of " " + chunk. Many are encoded in one text, which the tokenizer cuts before
        each blank, and told apart by the bytes their ids stand for."""
        texts = [b"".join(chunks[k:k + 64]).decode("utf-8", "surrogatepass") for k in range(0, len(chunks), 64)]
        ids = np.frombuffer(b"".join(self._plainly(texts)), self.dtype)
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))) + 1
        return ids, np.diff(ends, prepend=0)

    def _some(self, texts: list[str]) -> list[bytes]:
        if not self.cuts or not texts:
            return self._plainly(texts) if texts else []
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([b"", *raw, b"", b"\n" * 8]), np.uint8)
        edge = np.cumsum([1, *(len(r) + 1 for r in raw)])  # where each text begins; its separator is before the next
        blank = np.flatnonzero(data == 32)
        odd = np.array([not t.isascii() and WIDE.search(t) is not None or any(x in t for x in self.added) for t in texts])
        whose = np.searchsorted(edge, blank, "right") - 1
        odd[whose[_SPACE[data[blank - 1]] | _SPACE[data[blank + 1]]]] = True
        low, high = np.searchsorted(blank, edge[:-1]), np.searchsorted(blank, edge[1:])
        #: A text's inner chunks run from each of its blanks to the next; the last has no blank after it.
        inner = np.ones(len(blank), bool)
        inner[high[high > low] - 1] = False
        inner &= ~odd[whose]
        start, stop = blank[inner], blank[np.flatnonzero(inner) + 1] if inner.any() else blank[:0]
        self._powers(len(data))
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=run[1:])
        long = stop - start
        key = mix64((run[stop] - run[start]) * self.back[start] + long.astype(np.uint64))
        key[long > LONGEST] = mix64(np.flatnonzero(long > LONGEST).astype(np.uint64) + np.uint64(1))  # no two are taken for one
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        entry = self.known.find(key)
        same = first[inverse]
        again, hit = np.flatnonzero(same != np.arange(len(same))), np.flatnonzero(entry >= 0)
        seen, found = first[hit], entry[hit]
        if ((long[again] != long[same[again]]) | (long[again] > LONGEST)).any() or (long[seen] != self.known.text_size[found]).any() \
                or _differ(data, start[again], data, start[same[again]], long[again]) \
                or _differ(data, start[seen], self.known.text, self.known.text_at[found].astype(np.int64), long[seen]):
            return self._plainly(texts)  # two chunks of one hash
        new = np.flatnonzero(entry < 0)
        if len(new):
            bytes_ = data.tobytes()
            chunks = [bytes_[a:b] for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())]
            ids, sizes = self._learn(chunks)
            short = (stop - start)[first[new]] <= LONGEST
            try:
                if not short.all():
                    raise MemoryError
                entry[new] = self.known.add(key[new], ids, sizes, chunks)
                pool, at, size = self.known.pool, self.known.at, self.known.size
            except MemoryError:  # for these texts only: their own ids beside those that are known
                entry[new] = len(self.known.at) + np.arange(len(new))
                pool = np.concatenate([self.known.pool[:self.known.used], ids])
                at = np.concatenate([self.known.at, self.known.used + np.cumsum(sizes) - sizes])
                size = np.concatenate([self.known.size, sizes])
                if len(self.known.at) + len(new) > REMEMBERED:
                    self.known.clear()
        else:
            pool, at, size = self.known.pool, self.known.at, self.known.size
        entry = entry[inverse]
        n = size[entry].astype(np.int64)
        stops = np.cumsum(n)
        flat = pool[np.repeat(at[entry] - stops + n, n) + np.arange(int(stops[-1]) if len(stops) else 0)].tobytes()
        cut = np.append(0, stops) * self.dtype.itemsize
        bounds = cut[np.searchsorted(start, edge)].tolist()
        single = self._plainly([x for i, t in enumerate(texts) for x in self._ends(t, bool(odd[i]))])
        return [single[2 * i] + flat[bounds[i]:bounds[i + 1]] + single[2 * i + 1] for i in range(len(texts))]

    @staticmethod
    def _ends(text: str, whole: bool) -> tuple[str, str]:
        """What is encoded by itself: the text before its first blank, and from its last one on."""
        first = -1 if whole else text.find(" ")
        return (text, "") if first < 0 else (text[:first], text[text.rfind(" "):])

    def encode(self, texts: list[str]) -> list[bytes]:
        done: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > AT_ONCE:
                done += self._some(group) if group else []
                group, size = [], 0
                done.append(b"".join(self._some([s])[0] for s in self._slices(text)))
                continue
            group.append(text)
            size += len(text)
            if size > AT_ONCE:
                done += self._some(group)
                group, size = [], 0
        return done + (self._some(group) if group else [])

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id of a byte-level vocabulary stands for."""
        out = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(token.encode() if token in self.added else token)  # others are written one character a byte
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One for each Python worker and vocabulary; the path is that of the installed file on the executor if None."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Which section gets a token that crosses a boundary.
RULES = ("start", "end", "most", "share")


def _char_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and last character + 1 of each token, from the bytes each token stands for."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def attribute(text: str, lengths: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; edges are the sections' first characters, from 0."""
    if not len(lengths):
        return np.zeros(len(edges))
    first, last = _char_spans(text, lengths)
    a = np.searchsorted(edges, first, "right") - 1
    b = np.searchsorted(edges, last - 1, "right") - 1
    if rule in ("start", "end"):
        return np.bincount(a if rule == "start" else b, minlength=len(edges)).astype(float)
    inside = a == b
    out = np.bincount(a[inside], minlength=len(edges)).astype(float)
    ends = np.append(edges[1:], len(text))
    for k in np.flatnonzero(~inside):
        s = np.arange(a[k], b[k] + 1)
        share = np.minimum(ends[s], last[k]) - np.maximum(edges[s], first[k])
        if rule == "most":
            out[s[np.argmax(share)]] += 1
        else:
            out[s] += share / share.sum()
    return out


def count_section_tokens(docs: DataFrame, boundary: str = "\n", rule: str = "start", path: str | None = None) -> DataFrame:
    """(doc_id, section, start, n_chars, n_tokens): tokens of each section of every text.

    A text is encoded once, whole. A section ends with each match of the regular expression `boundary`, which belongs
    to it. Token spans are joined to sections by their first and last characters; a token over a boundary counts for
    the section of its first character ("start"), of its last ("end"), of most of its characters, the earlier one if
    equal ("most"), or for each in proportion ("share"). The counts of a document add up to its tokens.

    Defined cases: null and empty texts are one empty section with 0 tokens; rows with equal or null doc_id are
    counted one by one; an empty table gives no rows; other columns are ignored."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")

    def counted(batches):
        enc, ends = encoder(path), re.compile(boundary)
        size = enc.byte_lengths()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):
                rows: list[list] = [[], [], [], [], []]
                ids, part = (batch.column(k).slice(at, AT_A_TIME).to_pylist() for k in (0, 1))
                for doc, text, packed in zip(ids, part, enc.encode(part)):
                    edges = np.array([0] + [m.end() for m in ends.finditer(text) if m.end() < len(text)], np.int64)
                    n = attribute(text, size[np.frombuffer(packed, enc.dtype)], edges, rule)
                    rows[0] += [doc] * len(edges)
                    for k, column in enumerate((np.arange(len(edges)), edges, np.diff(np.append(edges, len(text))), n), 1):
                        rows[k].append(column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(np.concatenate(rows[1]), pa.int32())]
                    + [pa.array(np.concatenate(rows[k]), pa.int64()) for k in (2, 3)] + [pa.array(np.concatenate(rows[4]), pa.float64())],
                    names=["doc_id", "section", "start", "n_chars", "n_tokens"])

    long_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        counted, "doc_id long, section int, start long, n_chars long, n_tokens double")


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_section_tokens(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("long"))
