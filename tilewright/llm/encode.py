"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is cut at single spaces between two other characters, where the
vocabulary's pattern always cuts too, so a batch has few distinct pieces and
each is encoded once. Distinct words of the new pieces are visited in sorted
order, which is the depth-first order of their trie: the last token of every
shared prefix is found once and stays on the path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tilewright.llm.words import slices
from tilewright.session import ship

#: Entries that a worker remembers before it starts anew.
MEMO = 200_000
NEVER = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Vocabulary of a rank file: a base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class TrieEncoder:
    """Encodes words by propagating, prefix by prefix, the last token of the encoding.

    The encoding of a prefix is that of a shorter prefix and one more token,
    namely the one token that ends there and may stand behind the shorter
    prefix's last token; two tokens may stand side by side if the merges of both
    leave the border between them alone.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.ends = {t[i:] for t in ranks for i in range(len(t))}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (token, token) for a single byte, None if no merges make it."""
        if token not in self.parts:
            text = self.tokens[token]
            found: tuple[int, int] | None = (token, token)
            if len(text) > 1:
                pieces = [text[i : i + 1] for i in range(len(text))]
                while len(pieces) > 2:
                    rank, at = min((self.ranks.get(pieces[i] + pieces[i + 1], NEVER), i) for i in range(len(pieces) - 1))
                    if rank >= token:
                        break
                    pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
                found = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
            self.parts[token] = found
        return self.parts[token]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank of the merge that takes it up) of the pieces that touch a border, the whole token first."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if len(self.tokens[token]) == 1:
                return out
            token, until = self.split(token)[side], token

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the border between the two survives: no merge across it comes before both pieces are taken up elsewhere.

        Of equal ranks the merge further left is first.
        """
        key = (left, right)
        if key not in self.beside:
            self.beside[key] = not any(
                (rank := self.ranks.get(self.tokens[a] + self.tokens[b])) is not None and rank < until_a and rank <= until_b
                for a, until_a in self.spine(left, 1)
                for b, until_b in self.spine(right, 0)
            )
        return self.beside[key]

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Token ids of distinct words, shared prefixes once."""
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]  # last token of each prefix on the path
        before = b""
        ranks, ends, tokens = self.ranks, self.ends, self.tokens
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                here = []
                start = d - 1
                while start >= 0 and (tail := word[start:d]) in ends:
                    if (t := ranks.get(tail)) is not None:
                        here.append((start, t))
                    start -= 1
                for start, t in reversed(here):
                    if self.split(t) is not None and (start == 0 or self.may_follow(last[start], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, d = [], len(word)
            while d:
                ids.append(last[d])
                d -= len(tokens[last[d]])
            out[word] = ids[::-1]
            before = word
        return out


class CorpusEncoder:
    """Encodes batches of texts; remembers pieces and words within a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.trie = TrieEncoder(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def learn(self, new: list[str]) -> dict[str, list[int]]:
        """Ids of pieces that are not remembered."""
        if len(self.words) > MEMO:
            self.words.clear()
        if len(self.trie.beside) > 5 * MEMO:
            self.trie.beside.clear()
        cut = [self.find(p) for p in new]
        unknown = {w for ws in cut for w in ws} - self.words.keys()
        got = self.trie.encode([w.encode() for w in unknown])
        for w in unknown:
            self.words[w] = got[w.encode()]
        return {p: [i for w in ws for i in self.words[w]] for p, ws in zip(new, cut, strict=True)}

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """One list of ids per text; null and empty give an empty list."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        parts = pc.split_pattern(texts, " ")
        first = np.asarray(parts.offsets)[: n + 1].astype(np.int64) - int(parts.offsets[0].as_py())
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        opens = np.fromiter((not s or s[0].isspace() for s in names), bool, len(names))
        closes = np.fromiter((not s or s[-1].isspace() for s in names), bool, len(names))
        # a piece is joined to the one before where the space between them has white space or nothing beside it
        starts = np.ones(len(index), bool)
        starts[1:] = ~(opens[index[1:]] | closes[index[:-1]])
        head = np.zeros(len(index), bool)
        head[first[:-1]] = True
        starts |= head
        at = np.flatnonzero(starts)
        stop = np.append(at[1:], len(index))
        unit = index[at].copy()
        strings = [" " + s for s in names]
        for k in np.flatnonzero(head[at] | (stop - at > 1)):
            s = " ".join(names[j] for j in index[at[k] : stop[k]])
            unit[k] = len(strings)
            strings.append(s if head[at[k]] else " " + s)
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        known = self.pieces
        used = np.unique(unit)
        fresh = list({strings[u] for u in used} - known.keys())
        known.update(self.learn(fresh))
        lists = [known[strings[u]] for u in used]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
        where = np.searchsorted(used, unit)
        begin, size = (np.cumsum(sizes) - sizes)[where], sizes[where]
        ends = np.cumsum(size)
        source = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        total = np.append(0, ends)
        offsets = total[np.searchsorted(at, first)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[source], pa.int32()))


#: The encoder of a worker.
_ready: dict[int, CorpusEncoder] = {}


def encode_corpus(df: DataFrame, record: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``record`` and ``ids``: token ids of every whole text, without special tokens.

    ``vocabulary`` is the path of a rank file (about 1 MB, read once on the driver
    and broadcast); ``pattern`` cuts a text into words before the merges. Null and
    empty texts give an empty list; every row gives one row, repeated or not. No
    shuffle.
    """
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    kind = dict(df.dtypes)[record]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tilewright.llm.encode import _ready as ready  # the worker's own, which lasts from task to task

        key = hash((data.value, pattern))
        if key not in ready:
            ready.clear()
            ready[key] = CorpusEncoder(read_ranks(data.value), pattern)
        for batch in batches:
            for part in slices(batch, "t"):
                ids = ready[key].batch(part.column("t"))
                yield pa.RecordBatch.from_arrays([part.column("r"), ids], names=[record, "ids"])

    return df.selectExpr(f"`{record}` as r", f"`{text}` as t").mapInArrow(run, f"`{record}` {kind}, ids array<int>")
