"""Token ids of call logs by a byte-level BPE vocabulary, and the logs back from their ids: speculate, verify, repair.

A word's ids are first proposed by greedy longest match, all words of a block side by side. Byte-pair encoding gives exactly
these ids if each two neighbours are compatible, that is, if merging would not join anything across their border.
Every pair of neighbours is tested so; only words with a pair that fails are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from rankscope.llm import words as W
from rankscope.llm.stage import carried
from rankscope.llm.tokens import tokenizer_file

CACHED = 300_000  # words whose ids a worker remembers
LONG = 512        # bytes of a word from which its longest matches are looked up at all places at once
NEVER = np.int64(1) << 40

# Letters that a word of its own may begin with after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for every byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


def _classes() -> np.ndarray:
    """Kind of every code point as the tokenizers library sees it: 1 letter, 2 number, 3 white space, 0 all else."""
    from tokenizers import Regex, normalizers
    points = np.array([c for c in range(0x10FFFF) if not 0xD800 <= c < 0xE000], np.uint32)
    text, mark = points.tobytes().decode("utf-32-le"), "\U0010FFFF"
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in enumerate((r"\p{L}", r"\p{N}", r"\s"), 1):
        marked = normalizers.Replace(Regex(pattern), mark).normalize_str(text)
        kinds[points[np.frombuffer(marked.encode("utf-32-le"), "<u4") == 0x10FFFF]] = kind
    return kinds


class ByteEncoder:
    """Encodes and decodes many logs at once with one vocabulary file of the tokenizers library (byte-level BPE without normalizer)."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary, merges = made["model"]["vocab"], made["model"]["merges"]
        self.special = [(a["content"].encode(), a["id"]) for a in made["added_tokens"]]
        tokens = [b""] * (max([*vocabulary.values(), *(i for _, i in self.special)]) + 1)
        for text, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in text)
        for text, i in self.special:
            tokens[i] = text
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.sizes = np.diff(self.ends, prepend=0)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.left, self.right = np.full(len(tokens), -1, np.int64), np.full(len(tokens), -1, np.int64)
        self.rank = np.full(len(tokens), -1, np.int64)  # of the merge that makes a token; -1 for single bytes
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            pair, whole = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            self.merge[pair] = (rank, whole)
            if self.rank[whole] < 0:
                self.rank[whole] = rank
                self.left[whole], self.right[whole] = pair
        keys = np.array([a << 20 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.pair_tokens = np.array([t for _, t in self.merge.values()], np.int64)[order]
        self.byte_id = np.array([vocabulary[letter] for letter in byte_letters()], np.int64)
        self._plant([(tokens[i], i) for i in vocabulary.values()])
        self.kinds = _classes()
        self.prints = np.empty(0, np.uint64)
        self._forget()

    def _plant(self, tokens: list[tuple[bytes, int]]) -> None:
        """A trie of the tokens that encode to themselves; a child is found by its node and byte."""
        child: dict[int, int] = {}
        accept = [-1]
        for text, i in tokens:
            if self._merged(text) != [i]:
                continue
            node = 0
            for b in text:
                node = child.setdefault(node << 8 | b, len(accept))
                if node == len(accept):
                    accept.append(-1)
            accept[node] = i
        keys = np.array(list(child), np.int64)
        order = np.argsort(keys)
        self.children, self.nodes = keys[order], np.array(list(child.values()), np.int64)[order]
        self.accept = np.array(accept, np.int64)

    def _forget(self) -> None:
        self.prints = np.empty(0, np.uint64)  # known words, sorted
        self.known = np.empty(0, np.int64)    # their places in begins
        self.ids, self.begins = np.empty(0, np.uint32), np.zeros(1, np.int64)

    # --- words ----------------------------------------------------------------

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word in order, and the special token it is (or -1)."""
        text = data.tobytes()
        at_special, special = [], []
        for content, i in self.special:
            at = text.find(content)
            while at >= 0:
                row = np.searchsorted(offsets, at, "right")
                if at + len(content) <= offsets[row]:
                    at_special.append((at, at + len(content)))
                    special.append(i)
                    at = text.find(content, at + len(content))
                else:
                    at = text.find(content, at + 1)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # bytes where a character begins
        n = len(first)
        points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
        kind = self.kinds[points]
        cut = np.zeros(n + 1, bool)  # a word cannot cross these characters' beginnings
        cut[np.searchsorted(first, offsets)] = True
        inside = np.zeros(n + 1, np.int8)
        for a, b in at_special:
            i, j = np.searchsorted(first, [a, b])
            cut[i] = cut[j] = True
            inside[i:j] = 1
        cut[n] = True
        start = cut.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        space = kind == 3
        # The last white space before something else begins a word of its own, or the next word if it is a blank.
        before = np.zeros(n, bool)
        before[:-1] = space[:-1] & ~space[1:] & ~cut[1:n]
        start[:n] |= before
        glued = np.zeros(n + 1, bool)
        glued[1:n] = before[:-1] & (points[:-1] == 0x20)
        start &= ~glued
        # An apostrophe that stands alone, not behind a blank, takes one of the endings with it.
        lone = np.flatnonzero((points == 0x27) & start[:n] & (inside[:n] == 0))
        lone = lone[lone + 1 < n]
        lone = lone[start[lone + 1] & ~cut[lone + 1]]
        for ending in ENDINGS:
            fits = lone[lone + len(ending) < n] if len(ending) > 1 else lone
            for k, letter in enumerate(ending, 1):
                fits = fits[(points[fits + k] == ord(letter)) & ~cut[fits + k]]
            start[fits + 1] = False
            start[fits + 1 + len(ending)] = True
        start[:n] &= inside[:n] == 0
        bounds = np.append(first, len(data))
        for a, _ in at_special:
            start[np.searchsorted(first, a)] = True
        begins = bounds[np.flatnonzero(start)]
        begins = begins[begins < len(data)]
        which = np.full(len(begins), -1, np.int64)
        for (a, _), i in zip(at_special, special):
            which[np.searchsorted(begins, a)] = i
        return begins, np.append(begins[1:], len(data)), which

    # --- proposals ------------------------------------------------------------

    def _longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place and stays within its end."""
        best = np.full(len(at), -1, np.int64)
        live, node, place = np.arange(len(at)), np.zeros(len(at), np.int64), at.copy()
        while len(live):
            key = node << 8 | data[place]
            found = np.minimum(np.searchsorted(self.children, key), len(self.children) - 1)
            hit = self.children[found] == key
            live, node, place = live[hit], self.nodes[found[hit]], place[hit] + 1
            token = self.accept[node]
            best[live[token >= 0]] = token[token >= 0]
            more = place < ends[live]
            live, node, place = live[more], node[more], place[more]
        return best

    def _propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy ids of all words one behind the other, and the word of each."""
        word, order, ids = [], [], []
        long = ends - starts > LONG
        live = np.flatnonzero(~long)
        at, step = starts.copy(), 0
        while len(live):
            token = self._longest(data, at[live], ends[live])
            word.append(live)
            order.append(np.full(len(live), step))
            ids.append(token)
            at[live] += self.sizes[token]
            live, step = live[at[live] < ends[live]], step + 1
        for w in np.flatnonzero(long):
            places = np.arange(starts[w], ends[w])
            token = self._longest(data, places, np.full(len(places), ends[w]))
            jumps, chain, i = self.sizes[token].tolist(), [], 0
            while i < len(jumps):
                chain.append(i)
                i += jumps[i]
            word.append(np.full(len(chain), w))
            order.append(np.arange(len(chain)))
            ids.append(token[chain])
        if not word:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word, order, ids = map(np.concatenate, (word, order, ids))
        sort = np.lexsort((order, word))
        return ids[sort], word[sort]

    # --- verification ---------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether byte-pair encoding of the two tokens' bytes gives just the two tokens.

        What may meet at the border are the tokens down the right side of ``a`` and down the left side of ``b``. They are taken
        apart from the latest merge to the earliest; a pair met on the way joins if its merge comes before both its
        parts' own next merges (on a tie, the one further left comes first).
        """
        fits = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        next_a, next_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            key = a << 20 | b
            found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joined = np.where(self.pair_keys[found] == key, self.pair_ranks[found], NEVER)
            bad = (joined < next_a) & (joined <= next_b) & (joined < NEVER)
            fits[live[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~bad & ((rank_a >= 0) | (rank_b >= 0))
            live, a, b, next_a, next_b, rank_a, rank_b = (x[go] for x in (live, a, b, next_a, next_b, rank_a, rank_b))
            undo_a = rank_a >= rank_b
            next_a, next_b = np.where(undo_a, rank_a, next_a), np.where(undo_a, next_b, rank_b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return fits

    def _merged(self, word: bytes) -> list[int]:
        """Exact merging of one word: always the earliest merge, of several the leftmost."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merge[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != pair[0] or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.merge[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for x in (prior[i], i):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], x, p))
        return [i for i in ids if i >= 0]

    def _merged_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words, one merge of every word a round: their ids, and the word of each."""
        sizes = ends - starts
        until = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.byte_id[data[np.repeat(starts - until[:-1], sizes) + np.arange(until[-1])]]
        word = np.repeat(np.arange(len(starts)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            key = ids[:-1] << 20 | ids[1:]
            found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.append(np.where((self.pair_keys[found] == key) & (word[1:] == word[:-1]), self.pair_ranks[found], NEVER), NEVER)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = least == NEVER
            done_ids.append(ids[over])
            done_words.append(word[over])
            at = np.flatnonzero((rank == least) & ~over)
            at = at[np.unique(word[at], return_index=True)[1]]
            ids[at] = self.pair_tokens[found[at]]
            keep = ~over
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(done_ids), np.concatenate(done_words)

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one behind the other, and where each word's begin (one more at the end)."""
        ids, word = self._propose(data, starts, ends)
        same = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[same] << 20 | ids[same + 1], return_inverse=True)
        wrong = np.unique(word[same[~self.compatible(pairs >> 20, pairs & 0xFFFFF)[which]]])
        if len(wrong):
            failed = np.zeros(len(starts), bool)
            failed[wrong] = True
            long = wrong[ends[wrong] - starts[wrong] > LONG]
            short = wrong[ends[wrong] - starts[wrong] <= LONG]
            short_ids, of = self._merged_words(data, starts[short], ends[short])
            long_ids = [self._merged(data[starts[w]:ends[w]].tobytes()) for w in long]
            keep = ~failed[word]
            word = np.concatenate([word[keep], short[of], np.repeat(long, [len(x) for x in long_ids])])
            ids = np.concatenate([ids[keep], short_ids, *[np.array(x, np.int64) for x in long_ids]])
            order = np.argsort(word, kind="stable")
            ids, word = ids[order], word[order]
        return ids.astype(np.uint32), np.searchsorted(word, np.arange(len(starts) + 1))

    # --- logs -----------------------------------------------------------------

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the place where each row's begin (one more at the end)."""
        data, offsets = W.texts(column)
        starts, ends, special = self._words(data, offsets)
        prints, at, which = np.unique(W.fingerprints(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.prints) > CACHED:
            self._forget()
        place = np.searchsorted(self.prints, prints)
        new = np.flatnonzero(self.prints[np.minimum(place, len(self.prints) - 1)] != prints) if len(self.prints) else np.arange(len(prints))
        ids, begins = self._encode_words(data, starts[at[new]], ends[at[new]])
        n = len(self.begins) - 1
        self.begins = np.concatenate([self.begins, self.begins[-1] + begins[1:]])
        self.ids = np.concatenate([self.ids, ids])
        all_prints, all_known = np.concatenate([self.prints, prints[new]]), np.concatenate([self.known, n + np.arange(len(new))])
        order = np.argsort(all_prints, kind="stable")
        self.prints, self.known = all_prints[order], all_known[order]
        known = self.known[np.searchsorted(self.prints, prints)]
        begin, lengths = self.begins[known], self.begins[known + 1] - self.begins[known]
        per_word = np.where(special >= 0, 1, lengths[which])
        until = np.concatenate([[0], np.cumsum(per_word)])
        source = np.repeat(begin[which] - until[:-1], per_word) + np.arange(until[-1])
        out = self.ids[np.where(np.repeat(special >= 0, per_word), 0, source)] if len(self.ids) else np.empty(0, np.uint32)
        marks = np.flatnonzero(special >= 0)
        out[until[marks]] = special[marks]
        return out, until[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows in one array, and where each row's begin; numbers that are no token give nothing."""
        ids = ids.astype(np.int64)
        real = ids < len(self.sizes)
        ids = np.where(real, ids, 0)
        sizes = np.where(real, self.sizes[ids], 0)
        until = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.ends[ids] - self.sizes[ids] - until[:-1], sizes) + np.arange(until[-1])
        return self.bytes[source], until[begins]


@lru_cache(maxsize=1)
def byte_encoder(name: str) -> ByteEncoder:
    """The encoder of this worker process, which later tasks find with its words."""
    return ByteEncoder(tokenizer_file(name))


def _binary(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of bytes cut from one buffer at ``offsets``."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def encode_logs(logs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Token ids of every whole log by a byte-level vocabulary, special tokens in the text taken as such, none added.

    ``logs`` has ``log`` string (``records.rank_logs`` makes such rows); other columns go through, those named like a result are replaced.
    Returns ``n_tokens`` long and ``ids`` binary, the ids as little-endian unsigned 32-bit numbers. A null or empty log has no
    tokens. Repeated rows and ties are encoded alike, no rows give no rows. A task holds the temporaries of a few
    megabytes of text, or of one longer log. Each block is decoded again; a log that does not come back byte for byte
    (two words with one fingerprint) is encoded anew without remembered words.
    """
    kept = carried(logs, ["n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(tokenizer)
        for batch in W.blocks(batches, "log"):
            column = batch.column("log")
            ids, begins = coder.encode(column)
            data, offsets = W.texts(column)
            back, ends = coder.decode(ids, begins)
            if len(back) != len(data) or (back != data).any() or (ends != offsets).any():
                parts = []
                for row in range(batch.num_rows):
                    part = ids[begins[row]:begins[row + 1]]
                    if coder.decode(part, np.array([0, len(part)]))[0].tobytes() != data[offsets[row]:offsets[row + 1]].tobytes():
                        coder._forget()
                        part = coder.encode(column.slice(row, 1))[0]
                    parts.append(part)
                ids, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.diff(begins), pa.int64()), _binary(ids.astype("<u4"), begins * 4, pa.binary())],
                [*kept, "n_tokens", "ids"])

    schema = T.StructType([*[logs.schema[c] for c in kept], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return logs.select(*kept).mapInArrow(run, schema)


def decode_logs(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The logs that ``ids`` stand for, special tokens written out.

    ``encoded`` has ``ids`` binary as ``encode_logs`` makes them; null has no tokens. Returns its other columns with ``log``; a column
    named ``log`` is replaced. Numbers that are no token are left out; bytes that are no UTF-8 become U+FFFD. No rows give no rows.
    """
    kept = [c for c in carried(encoded, ["log"]) if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(tokenizer)
        for batch in batches:
            for part in _portions(batch):
                rows = [x[:len(x) // 4 * 4] if x else b"" for x in part.column("ids").to_pylist()]
                begins = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows], dtype=np.int64)])
                data, offsets = coder.decode(np.frombuffer(b"".join(rows), "<u4"), begins)
                texts = _binary(data, offsets, pa.string())
                try:
                    texts.validate(full=True)
                except pa.ArrowInvalid:
                    texts = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets, offsets[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], texts], [*kept, "log"])

    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField("log", T.StringType())])
    return encoded.select(*kept, "ids").mapInArrow(run, schema)


def _portions(batch: pa.RecordBatch, size: int = W.BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about ``size`` bytes of ids or one longer row."""
    until = np.cumsum(pc.fill_null(pc.binary_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        held = until[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(until, held + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop
