"""BPE encoding and decoding: speculate with greedy longest match, verify adjacent pairs, repair the rest.

A token sequence is what the merge rules give exactly when every adjacent pair of it is (each token being
what the rules give for its own characters). So a word is cut greedily into longest tokens, all adjacent
pairs of all new words are tested together with array operations, and only words with a failing pair are
merged step by step. Words are looked up once per Python worker in a table of bounded size.

Normalisation and word splitting come from the tokenizer file itself and act inside the runs between
ASCII white space, which no rule of the file crosses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm import bytescan as bs

#: Runs that a worker remembers before it starts anew; it forgets them at the end of a task too.
MEMORY_WORDS = 60_000
#: Rows that one output batch holds at most, and bytes of text.
OUT_ROWS, OUT_BYTES = 2_000, 4_000_000
NEVER = 1 << 40
NO_RANK = np.int64(NEVER)
FREE = (NEVER, -1)
#: Marks that may stand behind a plain word.
MARKS = ".,;!?"
#: The word end as a trie symbol, and the number of symbols.
END, SYMBOLS = 256, 257


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class BpeModel:
    """Tables of one tokenizer file (``tokenizers`` JSON with a BPE model and no decoder)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = s
        whole = Tokenizer.from_file(path)
        self.normalize = whole.normalizer.normalize_str if whole.normalizer else (lambda s: s)
        self.split = whole.pre_tokenizer.pre_tokenize_str
        n = len(self.tokens)
        self.size = n
        # rank of the merge that makes a token (-1: a base symbol), and the two tokens it joins
        self.rank = np.full(n, -1, np.int64)
        self.left = np.arange(n)
        self.right = np.arange(n)
        self.merges: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault(i * n + j, (r, k))
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        keys = np.array([*self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_token = np.array([k for _, k in self.merges.values()], np.int64)[order]
        self.key_rank = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.longest = max(map(len, self.vocab))
        # a token may be proposed only if the merges rebuild it from its own characters
        self.usable = {s for s, i in self.vocab.items() if self.merge(self.symbols(s)) == [i]}
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.plain = np.array([self.vocab.get(c, -1) for c in byte_alphabet()], np.int64)
        self.final = np.array([self.vocab.get(c + self.suffix, -1) for c in byte_alphabet()], np.int64)
        self.grow_trie()
        self.simple = self.reads_plainly()
        self.memory: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def symbols(self, token: str) -> list[int]:
        """Base symbols of a token string (of a word: with the word end on the last character)."""
        end = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
        body = token[: -len(self.suffix)] if end else token
        marks = [*body]
        if end:
            marks[-1] += self.suffix
        return [self.vocab[c] for c in marks if c in self.vocab]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        ids, get, n = list(ids), self.merges.get, self.size
        ranks = [get(a * n + b, FREE)[0] for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [get(ids[at] * n + ids[at + 1])[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] * n + ids[at], FREE)[0]
            if at < len(ranks):
                ranks[at] = get(ids[at] * n + ids[at + 1], FREE)[0]
        return ids

    def base(self, word: bytes) -> list[int]:
        ids = self.plain[np.frombuffer(word, np.uint8)]
        if self.suffix and len(ids):
            ids[-1] = self.final[word[-1]]
        return ids.tolist()

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same result as :meth:`merge` in n log n steps, for long words."""
        import heapq

        n = len(ids)
        ids, nxt, prv = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        get, size = self.merges.get, self.size
        heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get(ids[k] * size + ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = nxt[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = get(a * size + b)[1], -1
            nxt[k] = nxt[j]
            if nxt[k] >= 0:
                prv[nxt[k]] = k
            for x, y in ((prv[k], k), (k, nxt[k])):
                if x >= 0 and y >= 0 and (m := get(ids[x] * size + ids[y])):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def grow_trie(self) -> None:
        """Usable tokens as a trie over bytes; the word end is the extra symbol END. Edges are kept sorted."""
        edges: dict[int, int] = {}
        token = [-1]
        for t in self.usable:
            ends = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            body = t[: -len(self.suffix)] if ends else t
            if any(c not in self.byte_of for c in body):
                continue
            node = 0
            for sym in [*(self.byte_of[c] for c in body), *([END] if ends else [])]:
                key = node * SYMBOLS + sym
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = self.vocab[t]
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.node_token = np.array(token, np.int64)

    def step(self, node: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Child nodes; -1 where the trie ends."""
        key = node * SYMBOLS + sym
        at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
        return np.where(self.edge_keys[at] == key, self.edge_to[at], -1)

    def speculate(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest tokens from the left for all words at once: (word, id) in order, and the words where no token fits."""
        at, live = start.copy(), np.arange(len(start))
        owners, ids, stuck = [], [], []
        while len(live):
            best = np.full(len(live), -1, np.int64)
            reach = np.zeros(len(live), np.int64)
            on, node, pos = np.arange(len(live)), np.zeros(len(live), np.int64), at[live].copy()
            while len(on):
                over = pos[on] >= end[live[on]]
                sym = np.where(over, END, data[np.minimum(pos[on], len(data) - 1)])
                node[on] = self.step(node[on], sym)
                on, over = on[node[on] >= 0], over[node[on] >= 0]
                pos[on] += 1
                tok = self.node_token[node[on]]
                # a token without word end may not take the last byte, which carries the word end
                fits = (tok >= 0) & (over | (pos[on] < end[live[on]]) | (not self.suffix))
                best[on[fits]], reach[on[fits]] = tok[fits], pos[on[fits]]
                on = on[~over]
            found = best >= 0
            stuck.append(live[~found])
            owners.append(live[found])
            ids.append(best[found])
            at[live[found]] = reach[found]
            live = live[found & (reach < end[live])]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return owner[order], np.concatenate(ids)[order], np.concatenate(stuck)

    def merge_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Exact merging of many short words side by side: one merge of every unfinished word per round."""
        size = end - start
        n, width = len(start), int(size.max())
        col = np.arange(width)
        inside = col[None, :] < size[:, None]
        byte = data[np.minimum(start[:, None] + col[None, :], len(data) - 1)]
        ids = np.where(inside, self.plain[byte], -1)
        if self.suffix:
            ids[np.arange(n), size - 1] = self.final[data[end - 1]]
        rank = np.full((n, width), NEVER, np.int64)
        both = inside[:, 1:]
        r, c = np.nonzero(both)
        rank[r, c] = self.rank_of(ids[r, c], ids[r, c + 1])
        live = np.arange(n)
        while len(live):
            k = rank[live].argmin(axis=1)
            go = rank[live, k] < NEVER
            live, k = live[go], k[go]
            if not len(live):
                break
            key = ids[live, k] * self.size + ids[live, k + 1]
            made = self.key_token[np.searchsorted(self.keys, key)]
            # close the gap: everything right of the merged pair moves one place left
            shift = col[None, :] > k[:, None]
            block, ranks = ids[live], rank[live]
            block[:, :-1] = np.where(shift[:, :-1], block[:, 1:], block[:, :-1])
            ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            block[np.arange(len(live)), k] = made
            size[live] -= 1
            block[np.arange(len(live)), size[live]] = -1
            ranks[np.arange(len(live)), np.maximum(size[live] - 1, 0)] = NEVER
            for left in (k - 1, k):
                ok = (left >= 0) & (left + 1 < size[live])
                q = np.flatnonzero(ok)
                ranks[q, left[q]] = self.rank_of(block[q, left[q]], block[q, left[q] + 1])
            ids[live], rank[live] = block, ranks
        return [ids[i, : size[i]] for i in range(n)]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NO_RANK)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: do the merge rules leave the border between them alone?

        The merges inside both tokens are undone latest first. While a piece exists, a merge across the
        border that ranks before the merge which ends that piece would have come first: then the pair fails.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NO_RANK, np.int64)
        while len(live):
            x, y = a[live], b[live]
            broken = self.rank_of(x, y) < limit[live]
            good[live[broken]] = False
            live = live[~broken]
            x, y = a[live], b[live]
            rx, ry = self.rank[x], self.rank[y]
            going = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            later_left = rx > ry
            a[live] = np.where(later_left, self.right[x], x)
            b[live] = np.where(later_left, y, self.left[y])
            # of equal ranks the leftmost merges first: across the border comes before one inside the right token
            limit[live] = np.where(later_left, rx, ry + 1)
        return good

    def cut(self, run: bytes) -> list:
        """Words (UTF-8 bytes) and ids of added tokens of one run of non-blank bytes."""
        text = run.decode("utf-8", "replace")
        # letters of Latin-1 with at most some full stops and commas behind: normal form and word borders are plain
        body = text.rstrip(MARKS)
        if self.simple and body.isalpha() and max(body) < "\u0100":
            low = body.lower().encode()
            return [low] if len(body) == len(text) else [low, text[len(body) :].encode()]
        return self.cut_by_file(text)

    def reads_plainly(self) -> bool:
        """Does this file lower-case Latin-1 letters, keep them in one word, and the marks behind them in another?"""
        letters = "".join(c for c in map(chr, range(256)) if c.isalpha())
        words = [letters, letters[::-1], *letters]
        ends = [MARKS, MARKS[::-1], *MARKS]
        plain = all(self.cut_by_file(w) == [w.lower().encode()] for w in words) and all(self.cut_by_file(w + e) == [w.lower().encode(), e.encode()] for w in words for e in ends)
        return plain and not any(t.rstrip(MARKS).isalpha() or not t.strip(MARKS) for t in self.added)

    def cut_by_file(self, text: str) -> list:
        """As :meth:`cut`, all by the file's normaliser and word borders."""
        parts: list = [text]
        for content, i in self.added.items():
            if content in text:
                fresh: list = []
                for p in parts:
                    bits = p.split(content) if isinstance(p, str) else [p]
                    for k, bit in enumerate(bits):
                        fresh += ([i] if k else []) + ([bit] if bit != "" else [])
                parts = fresh
        out: list = []
        to_byte = self.byte_of
        for p in parts:
            out += [p] if isinstance(p, int) else [bytes(map(to_byte.__getitem__, w)) for w, _ in self.split(self.normalize(p))]
        return out

    def learn(self, runs: list[bytes]) -> None:
        """Encode new runs of non-blank bytes and remember them."""
        plan = [self.cut(run) for run in runs]
        known = self.words
        words = list({w for steps in plan for w in steps if not isinstance(w, int)}.difference(known))
        if words:
            data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size)
            start = end - size
            owner, ids, stuck = self.speculate(data, start, end)
            bad = np.zeros(len(words), bool)
            bad[stuck] = True
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            uniq, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
            good = self.compatible(uniq // self.size, uniq % self.size)
            bad[owner[inner[~good[back]]]] = True
            packed = ids.astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
            last = 0
            for w, stop in zip(words, ends, strict=True):
                known[w] = packed[4 * last : 4 * stop]
                last = stop
            for low, high in ((0, 12), (12, 24), (24, 60)):
                some = np.flatnonzero(bad & (size > low) & (size <= high))
                if len(some):
                    for k, merged in zip(some.tolist(), self.merge_all(data, start[some], end[some]), strict=True):
                        known[words[k]] = merged.astype("<u4").tobytes()
            for k in np.flatnonzero(bad & (size > 60)).tolist():
                known[words[k]] = np.array(self.merge_long(self.base(words[k])), "<u4").tobytes()
        memory = self.memory
        for run, steps in zip(runs, plan, strict=True):
            memory[run] = known[steps[0]] if len(steps) == 1 and type(steps[0]) is bytes else b"".join(x.to_bytes(4, "little") if isinstance(x, int) else known[x] for x in steps)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, packed as little-endian unsigned 32-bit integers."""
        split = [text.split() for text in texts]
        if len(self.memory) > MEMORY_WORDS:
            self.forget()
        new = list({r for runs in split for r in runs}.difference(self.memory))
        if new:
            self.learn(new)
        return [b"".join(map(self.memory.__getitem__, runs)) for runs in split]

    def forget(self) -> None:
        self.memory.clear()
        self.words.clear()

    def decode(self, packed: bytes) -> str:
        """Token strings joined by blanks: what a tokenizer file without decoder gives."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_MODELS: dict[str, BpeModel] = {}


def model_of(path: str) -> BpeModel:
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of bounded rows and bytes (a longer single value stays whole)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        end = int(np.searchsorted(ends, before + OUT_BYTES, side="right"))
        end = max(first + 1, min(end, first + OUT_ROWS, batch.num_rows))
        yield batch.slice(first, end - first)
        first = end


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: token ids of the whole text as packed little-endian uint32 (binary).

    Null and empty texts give empty binary. An input column named ``out`` is replaced. Row order within a
    partition, repeated rows and all other columns stay as they are.
    """
    keep = [c for c in df.columns if c != out]
    fields = [df.schema[c] for c in keep]

    def run(batches):
        model = model_of(path)
        for whole in batches:
            for b in _slices(whole, text):
                texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                ids = pa.array(model.encode([t or b"" for t in texts]), pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), ids], [*keep, out])
        model.forget()  # the worker may serve other operators next
        bs.give_back()

    from pyspark.sql.types import BinaryType, StructField, StructType

    return df.select(*keep).mapInArrow(run, StructType([*fields, StructField(out, BinaryType())]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of packed ids. Null ids count as none and give an empty text."""
    keep = [c for c in df.columns if c != out]
    fields = [df.schema[c] for c in keep]

    def run(batches):
        model = model_of(path)
        for whole in batches:
            for b in _slices(whole, ids):
                packed = b.column(b.schema.get_field_index(ids)).to_pylist()
                texts = pa.array([model.decode(p or b"") for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), texts], [*keep, out])
        bs.give_back()

    from pyspark.sql.types import StringType, StructField, StructType

    return df.select(*keep).mapInArrow(run, StructType([*fields, StructField(out, StringType())]))


def encode_and_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` as :func:`encode` and ``decoded`` as :func:`decode` do, in one pass: one Python worker a task holds the model, not two.

    The text itself is left out, all other columns stay.
    """
    keep = [c for c in df.columns if c not in (ids, decoded, text)]
    fields = [df.schema[c] for c in keep]

    def run(batches):
        model = model_of(path)
        for whole in batches:
            for b in _slices(whole, text):
                texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                packed = model.encode([t or b"" for t in texts])
                del texts
                said = pa.array([model.decode(p) for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(packed, pa.binary()), said], [*keep, ids, decoded])
        model.forget()
        bs.give_back()

    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    return df.select(*keep, text).mapInArrow(run, StructType([*fields, StructField(ids, BinaryType()), StructField(decoded, StringType())]))


def digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_and_decode(df.select("doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
