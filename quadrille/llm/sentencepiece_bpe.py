"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

All words of a slice of documents lie in one flat array of symbols. A round
finds each word's pair of least rank (a segmented minimum), merges all its
leftmost non-overlapping occurrences in all words at once, and compacts the
array; words without a pair left drop out.

Merging several occurrences at once equals merging them one by one only if no
merge makes a pair of equal or lower rank than its own. The table knows for
each piece whether that can happen; then only the word's leftmost occurrence
is merged in that round, or the leftmost of each cluster where occurrences lie
too far apart for a chain (at most a piece long) to reach from one to another.

Reading a very long word anew in every round would take a time that grows with
its square. From ``LONG`` symbols on, its pairs wait by rank, a round takes all
places of the least rank, and only their neighbours are looked up again, so time
stays nearly in proportion to the text, spaced or not.

Defined cases: a null or empty text has no ids and decodes to an empty text;
texts and words of any length are encoded as a whole; repeated rows give repeated
results; other columns play no part. Any characters are encoded: those without a
piece by the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept with their ids in each Python worker.
CACHED_WORDS = 1_000_000
#: Longest word that is kept, so that the store is bounded in bytes too.
KEPT_CHARS = 48
#: Symbols of a word from which its pairs wait by rank.
LONG = 512
NONE = np.int64(1) << 40


def _fields(data: bytes):
    """(field number, value) of a protobuf message: varints, 32-bit words or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


class PieceTable:
    """Pieces of a model file, the pairs that merge, and a store of encoded words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.pieces: list[str] = []
        scores, self.kinds = [], []
        normalizer: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models that keep the text as it is are supported")
        self.prefix = bool(normalizer.get(3, 1))
        mergeable = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER, UNUSED)}
        if any(k in (USER, UNUSED) for k in self.kinds) or any(SPACE in p.lstrip(SPACE) for p in mergeable):
            raise ValueError("only models whose pieces start new words at white space are supported")
        byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_ids = np.array([byte_id[b] for b in range(256)])
        self.byte_of = np.full(len(self.pieces), -1)
        self.byte_of[self.byte_ids] = np.arange(256)
        self.mergeable = mergeable
        # Symbols: pieces by id; then characters, as code points, above them.
        self.first_char = len(self.pieces)
        symbol = lambda s: mergeable.get(s, self.first_char + ord(s) if len(s) == 1 else None)
        rank_of_score = {s: r for r, s in enumerate(sorted({scores[i] for i in mergeable.values()}, reverse=True))}
        ranks = {p: rank_of_score[scores[i]] for p, i in mergeable.items()}
        pairs = []
        unsafe = np.zeros(len(self.pieces), bool)
        for p, i in mergeable.items():
            for cut in range(1, len(p)):
                left, right = symbol(p[:cut]), symbol(p[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, ranks[p], i))
                    for part in (p[:cut], p[cut:]):
                        if len(part) > 1 and ranks[part] >= ranks[p]:
                            unsafe[mergeable[part]] = True
        table = np.array(sorted(pairs), dtype=np.int64)
        self.span = np.int64(self.first_char + 0x110000)
        self.keys, self.rank, self.merged = table[:, 0] * self.span + table[:, 1], table[:, 2], table[:, 3]
        self.unsafe = unsafe
        self.reach = 2 * max(map(len, mergeable))
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for p, i in mergeable.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.texts = [bytes([self.byte_of[i]]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        self.words: dict[str, bytes] = {}
        self.longest_run = self._whole_run(ranks)

    def _whole_run(self, ranks: dict[str, int]) -> int:
        """Length n of the longest white-space piece, if runs merge after all else and longer runs begin with n; else 0."""
        runs = [p for p in ranks if len(p) > 1 and not p.strip(SPACE)]
        if not runs or {ranks[p] for p in runs} != {max(r for p, r in ranks.items() if len(p) > 1)}:
            return 0
        n = max(map(len, runs))
        rest = self.encode_words([SPACE * j for j in range(1, 3 * n)])
        whole = self.encode_words([SPACE * (n + j) for j in range(1, 3 * n)])
        return n if all(x.tolist() == [self.mergeable[SPACE * n], *y.tolist()] for x, y in zip(whole, rest)) else 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE if they don't merge) and merged pieces of pairs of symbols."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their (ascending) word numbers when no pair is left; order is kept."""
        done_symbols, done_words = [], []
        while len(symbols):
            rank, piece = self._pairs(symbols[:-1], symbols[1:])
            rank = np.append(np.where(word[:-1] == word[1:], rank, NONE), NONE)
            piece = np.append(piece, 0)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            active = np.repeat(least < NONE, sizes)
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, piece = symbols[active], word[active], rank[active], piece[active]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(symbols):
                    break
            take = rank == np.repeat(least, sizes)
            number = np.repeat(np.arange(len(sizes)), sizes)
            # Words in which an occurrence's piece may start a chain: the leftmost of each cluster.
            careful = np.zeros(len(sizes), bool)
            careful[number[take & self.unsafe[piece]]] = True
            if careful.any():
                at = np.flatnonzero(take & careful[number])
                near = (number[at[1:]] == number[at[:-1]]) & (at[1:] - at[:-1] <= self.reach)
                take[at[1:][near]] = False
            # Of occurrences side by side (as in "aaaa") every other one, from the left.
            at = np.flatnonzero(take)
            start = np.append(True, (np.diff(at) > 1))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = piece[at]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            symbols, word = symbols[left], word[left]
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of one long word when no pair is left; merged pairs point to their neighbours."""
        n = len(symbols)
        symbol = np.append(symbols, -1)  # the last one stands beyond both ends
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        waiting: defaultdict[int, list[int]] = defaultdict(list)
        rank, _ = self._pairs(symbols[:-1], symbols[1:])
        at = np.argsort(rank, kind="stable")
        at = at[: np.searchsorted(rank[at], NONE)]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts):
            if len(part):
                waiting[int(rank[part[0]])] = part.tolist()
        ranks = list(waiting)
        heapify(ranks)
        while ranks:
            least = heappop(ranks)
            at = np.unique(np.array(waiting.pop(least)))
            at = at[alive[at]]
            right = after[at]
            rank, piece = self._pairs(symbol[at], symbol[right])
            fits = rank == least
            at, right, piece = at[fits], right[fits], piece[fits]
            if not len(at):
                continue
            # Of occurrences that overlap (as in "aaaa") every other one, from the left.
            start = np.append(True, right[:-1] != at[1:])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            even = place % 2 == 0
            at, right, piece = at[even], right[even], piece[even]
            left = symbol[before[at]]
            beside = np.append(False, before[at[1:]] == right[:-1])
            left[beside] = piece[:-1][beside[1:]]
            # A merge that makes a pair of no higher rank comes before all occurrences further right that its chain may reach.
            chains = (self._pairs(left, piece)[0] <= least) | (self._pairs(piece, symbol[after[right]])[0] <= least)
            if chains.any():
                cluster = np.cumsum(np.append(False, np.diff(at) > self.reach))
                first = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
                earlier = np.cumsum(chains) - chains
                taken = earlier == earlier[first][cluster]
                if not taken.all():
                    waiting[least] += at[~taken].tolist()
                    at, right, piece = at[taken], right[taken], piece[taken]
                    heappush(ranks, least)
            symbol[at], alive[right] = piece, False
            after[at] = after[right]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            around = np.unique(np.concatenate([before[at], at]))
            around = around[around >= 0]
            rank, _ = self._pairs(symbol[around], symbol[after[around]])
            new = rank < NONE
            for r, i in zip(rank[new].tolist(), around[new].tolist()):
                if r not in waiting:
                    heappush(ranks, r)
                waiting[r].append(i)
        return symbol[:n][alive[:n]]

    def merged_words(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and word numbers of all words when no pair is left."""
        sizes = np.bincount(word) if len(word) else np.zeros(0, np.int64)
        if not (sizes > LONG).any():
            return self.merge_rounds(symbols, word)
        long = sizes[word] > LONG
        parts = [self.merge_rounds(symbols[~long], word[~long])]
        ends = np.cumsum(sizes)
        for w in np.flatnonzero(sizes > LONG):
            merged = self.merge_long(symbols[ends[w] - sizes[w] : ends[w]])
            parts.append((merged, np.full(len(merged), w)))
        symbols, word = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words (white space only in front, as SPACE)."""
        if not words:
            return []
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        number = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        ids = self.char_ids[chars].astype(np.int64)
        symbols, number = self.merged_words(np.where(ids >= 0, ids, self.first_char + chars), number)
        if (other := np.flatnonzero(symbols >= self.first_char)).size:
            spelt = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (symbols[other] - self.first_char).tolist()]
            count = np.ones(len(symbols), np.int64)
            count[other] = [len(x) for x in spelt]
            symbols, number = np.repeat(symbols, count), np.repeat(number, count)
            symbols[symbols >= self.first_char] = np.concatenate(spelt)
        cuts = np.cumsum(np.bincount(number, minlength=len(words)))[:-1]
        return np.split(symbols.astype(np.int32), cuts)

    def split(self, text: str) -> list[str]:
        """A text's words, each with the white space before it."""
        if not text:
            return []
        flat = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        words = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", flat)
        if (n := self.longest_run) and SPACE * (2 * n) in flat:
            # White space merges after all else, from the left: whole pieces can be cut off in front.
            cut = []
            for w in words:
                extra = max(0, (len(w) - len(w.lstrip(SPACE)) - 2) // n)
                cut += [SPACE * n] * extra + [w[extra * n :]]
            words = cut
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, as the library gives them without begin and end.

        The first words met are the commonest, so they stay in the store when
        it is full; others, and long ones, are encoded for this call alone.
        """
        split = [self.split(x) for x in texts]
        every = set().union(*split)
        new = list(every.difference(self.words))
        found = dict(zip(new, (x.tobytes() for x in self.encode_words(new))))
        if len(self.words) + len(new) <= CACHED_WORDS:
            self.words.update(found)
            found = self.words
        else:
            found.update((w, self.words[w]) for w in every if w in self.words)
        ids = [np.frombuffer(b"".join(map(found.__getitem__, x)), np.int32) for x in split]
        for w in new:
            if len(w) > KEPT_CHARS:
                self.words.pop(w, None)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters, each by itself."""
        data = b"".join(map(self.texts.__getitem__, ids.tolist()))
        if self.prefix and len(ids) and self.pieces[ids[0]].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_slowly(data)

    @staticmethod
    def _decode_slowly(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [data[at : at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out)


@lru_cache(maxsize=2)
def piece_table(path: str | None = None) -> PieceTable:
    """The table of a model file on this machine; by default the installed 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceTable(path)


def encode_texts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids) of every whole text, with ``decoded`` on request. ``path`` names the file on the executors."""

    def make():
        table = piece_table(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = table.encode([x or "" for x in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            out = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))}
            if decode:
                out["decoded"] = pa.array([table.decode(x) for x in found], pa.string())
            return pa.RecordBatch.from_pydict(out)

        return each

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(picked, make, "doc_id long, ids array<int>" + ", decoded string" * decode)


def decode_ids(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with an array of ids; null ids give an empty text."""

    def run(batches):
        table = piece_table(path)
        for batch in batches:
            texts = [table.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the decoded text."""
    rows = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), decode=True)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
