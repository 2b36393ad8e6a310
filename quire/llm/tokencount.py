"""Exact token counts of every prefix by dynamic programming, without re-encoding.

The byte-level BPE splits a text into pieces and merges within each piece. For a piece, the last token of every prefix's
encoding follows from shorter prefixes: of the tokens that end there, exactly one may stand beside the last token of what
precedes it, so count[i] = count[i - len(token)] + 1. Two tokens may stand side by side if no merge that crosses the
boundary would have been made first, which the merge trees' facing edges tell. Pieces repeat, so each worker keeps the
table of a piece's prefix counts and a text's counts are running sums over its pieces.

PrefixCounts answers, from that table: the count of any prefix (count), and the longest prefix within a budget (truncate).
A prefix that ends inside a run of white space, or inside an apostrophe piece, is split afresh from its last settled piece.

Defined results: a null or empty text has 0 tokens; special strings in a text are one token each, as the library has them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as c

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: The pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Spaced(dict):
    """Tokens of a space and a chunk, for chunks as they come."""

    def __init__(self, model: Bpe):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[chunk] = sum(map(self.model.total, self.model.find(" " + chunk)))
        return n


class Bpe:
    """A byte-level BPE given by a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        decode = lambda s: bytes(letters[x] for x in s)
        self.ids = {decode(t): i for t, i in spec["model"]["vocab"].items() if all(x in letters for x in t)}
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (decode(x) for x in (m.split(" ") if isinstance(m, str) else m))
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x, y] = rank
            if z not in self.parts:
                self.parts[z], self.born[z] = (x, y), rank
        self.longest = max(map(len, self.ids))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer
        self._beside: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._totals: dict[str, int] = {}
        self._spaced = _Spaced(self)

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens on one edge (0 left, 1 right) of a token's merge tree: (token, rank of its birth, rank of the merge that takes it)."""
        out, dies = [], float("inf")
        while True:
            born = self.born.get(token, -1)
            out.append((token, born, dies))
            if born < 0:
                return out
            token, dies = self.parts[token][side], born

    def beside(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when their bytes are encoded together."""
        key = a << 20 | b
        known = self._beside.get(key)
        if known is None:
            known = True
            for x, x_born, x_dies in self._edge(a, 1):
                for y, y_born, y_dies in self._edge(b, 0):
                    rank = self.merges.get((x, y))
                    # of equal ranks the left merge comes first: x's own merge wins over this one, this one over y's
                    if rank is not None and x_born < rank and y_born < rank and rank < x_dies and rank <= y_dies:
                        known = False
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            self._beside[key] = known
        return known

    def _alone(self, token: int) -> bool:
        """Whether a token's own bytes encode to it."""
        known = self._whole.get(token)
        if known is None:
            p = self.parts.get(token)
            known = self._whole[token] = p is None or (self._alone(p[0]) and self._alone(p[1]) and self._meets(token, p))
        return known

    def _meets(self, token: int, p: tuple[int, int]) -> bool:
        for x, xb, xd in self._edge(p[0], 1):
            for y, yb, yd in self._edge(p[1], 0):
                rank = self.merges.get((x, y))
                if (x, y) != p and rank is not None and xb < rank and yb < rank and rank < min(xd, self.born[token]) and rank <= yd:
                    return False
        return True

    def piece(self, text: str) -> list[int]:
        """count[i]: tokens of the first i bytes of a piece."""
        w = text.encode("utf-8", "surrogatepass")
        n = len(w)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        token, known, longest = self.ids.get, self._beside.get, self.longest
        for i in range(1, n + 1):
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                t = token(w[j:i])
                if t is None:
                    continue
                if j:
                    fits = known(last[j] << 20 | t)
                    if fits is None:
                        fits = self.beside(last[j], t)
                else:
                    fits = self._alone(t)
                if fits:
                    last[i], count[i] = t, count[j] + 1
                    break
        return count

    def total(self, text: str) -> int:
        known = self._totals.get(text)
        if known is None:
            known = self.piece(text)[-1]
            if len(self._totals) >= CACHE:
                self._totals.clear()
            self._totals[text] = known
        return known

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is a special string), in order."""
        if self.split_special is None:
            yield text, False
            return
        for k, part in enumerate(self.split_special.split(text)):
            if part:
                yield part, bool(k % 2)

    def tokens(self, text: str) -> int:
        n, totals = 0, self._totals
        plain = self.split_special is None or not any(s in text for s in self.special)
        if plain and "  " not in text:
            # a piece always begins at a space that stands alone, so texts are sums over their space-led chunks
            head, _, tail = text.partition(" ")
            n = sum(map(self.total, self.find(head)))
            return n + sum(map(self._spaced.__getitem__, tail.split(" "))) if _ else n
        for part, special in ((text, False),) if plain else self.segments(text):
            if special:
                n += 1
                continue
            at, size = 0, len(part)
            while at < size:  # a very long text is split piece by piece in stretches, cut where a letter follows white space
                end = at + 200_000
                if end < size:
                    cut = regex.search(r"\S(?=\s\p{L})", part, pos=end)
                    end = cut.end() if cut else size
                for p in self.find(part, at, end) if end < size else self.find(part, at):
                    t = totals.get(p)
                    n += self.total(p) if t is None else t
                at = end
        return n


class PrefixCounts:
    """The counts of all prefixes of one text, answered from its pieces' tables."""

    def __init__(self, bpe: Bpe, text: str):
        self.bpe, self.text = bpe, text
        self.starts, self.before, self.special, at, n = [], [], [], 0, 0
        for part, special in bpe.segments(text):
            for p in [part] if special else bpe.find(part):
                self.starts.append(at)
                self.before.append(n)
                self.special.append(special)
                n += 1 if special else bpe.total(p)
                at += len(p)
        self.total = n

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        if chars <= 0 or not self.starts:
            return 0
        if chars >= len(self.text):
            return self.total
        k = int(np.searchsorted(self.starts, chars, side="right")) - 1
        if self.starts[k] == chars:
            k -= 1
        # white space at the end binds differently than before a word, so go back to the last piece before it
        while k and not self.special[k] and self.text[self.starts[k] : min(chars, self.starts[k] + 1)].isspace() and not self.special[k - 1] and self.text[self.starts[k] - 1].isspace():
            k -= 1
        if self.special[k] and chars < self.starts[k] + next(len(x) for x in self.bpe.special if self.text.startswith(x, self.starts[k])):
            while k and not self.special[k - 1]:  # a cut special string is ordinary text and may join what precedes it
                k -= 1
        rest = self.text[self.starts[k] : chars]
        if k + 1 < len(self.starts) and self.starts[k + 1] == chars and self.special[k]:
            return self.before[k] + 1
        pieces = self.bpe.find(rest)
        if len(pieces) == 1:
            return self.before[k] + self.bpe.piece(rest)[-1]
        return self.before[k] + sum(map(self.bpe.total, pieces))

    def all(self) -> np.ndarray:
        """count(p) for p = 0 .. len(text)."""
        out = np.zeros(len(self.text) + 1, np.int32)
        ends = [*self.starts[1:], len(self.text)]
        for k, (a, b) in enumerate(zip(self.starts, ends)):
            piece = self.text[a:b]
            if self.special[k] or piece[0].isspace() or piece[0] == "'":
                out[a + 1 : b + 1] = [self.count(p) for p in range(a + 1, b + 1)]
                continue
            table = self.bpe.piece(piece)
            sizes = np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in piece])
            out[a + 1 : b + 1] = self.before[k] + np.array(table)[sizes]
        return out

    def truncate(self, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        if self.total <= budget:
            return self.text
        p = len(self.text) - 1
        table = self.all()
        fits = np.flatnonzero(table[: p + 1] <= budget)
        return self.text[: int(fits[-1])]


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _counter(path: str):
    def run(it):
        model = bpe(path)
        for batch in it:
            for at, col in c.slices(batch.column(1)):
                n = [model.tokens(t) if t else 0 for t in col.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array(np.diff(c.buffers(col)[1])), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): the count at each text's last prefix."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counter(path or tokenizer_path()), "doc_id long, n_bytes long, n_tokens long")


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, counts): counts[p] is the number of tokens of the first p characters."""
    path = path or tokenizer_path()

    def run(it):
        model = bpe(path)
        for batch in it:
            for at, col in c.slices(batch.column(1), 1 << 18):
                counts = [PrefixCounts(model, t or "").all() for t in col.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, counts array<int>")


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """(doc_id, text): each text's longest prefix of at most `budget` tokens."""
    path = path or tokenizer_path()

    def run(it):
        model = bpe(path)
        for batch in it:
            for at, col in c.slices(batch.column(1), 1 << 18):
                cut = [PrefixCounts(model, t).truncate(budget) if t is not None else None for t in col.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array(cut, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(c.read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
