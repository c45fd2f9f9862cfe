"""Operator 2: SentencePiece encoding and decoding, with a max-plus scan over chunks of giant documents.

The ids are those of the given model under its merge rule. A sequence of pieces is the encoding of its
text exactly if each two neighbours are the encoding of their own concatenation, so encoding is a path
problem: nodes are occurrences of pieces, a step between neighbours weighs 0 if they are compatible and
minus infinity if not, and the encoding is the one path of weight 0. At a cut the state is the piece that
covers the character before it. A chunk gives the max-plus matrix from the states at its left cut to
those at its right cut; an associative scan over the matrices finds each chunk's two states; each chunk
is then traced back on its own. Documents of up to ``chunk`` characters are encoded whole.

No piece runs over the start of a word (a space after another character) or over a character that no
piece has, so words are encoded apart: a block of texts is cut at its spaces, each distinct word is looked
up once, and ids are gathered with numpy. A matrix only needs its chunk's first and last word. The same
kernel decodes the ids again and compares the bytes, so a task runs one Python worker.

Null and empty texts have no ids. White space is kept; the model writes a space as U+2581, so a text that
holds U+2581 itself decodes to a space there (``exact`` compares with the text so normalised). Lone
surrogates cannot occur in a Spark string. Repeated rows, null ids and extra columns change nothing;
empty tables give empty results. A document's ids are one row, so a document must fit in a task.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, parts_of, stash, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer documents are split.
CHUNK = 32_768
SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Pairs of pieces that a Python worker remembers, and the longest word that is merged beside others.
PAIRS = 50_000
SHORT = 32
#: Bytes of text, and chunks of giant documents, that are handled at a time.
BLOCK = 1 << 22
ROWS = 16
#: Words merged side by side, and the rank of a pair that forms no piece.
WORDS = 50_000
NEVER = np.int32(2**31 - 1)

State = tuple[int, int]


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.bytes_of.append(piece.encode())
        self.reach = max(map(len, self.ids), default=1)
        alphabet = "".join(sorted({c for piece in self.ids for c in piece} - {SPACE}))
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("the model has pieces over the start of a word")
        known = "".join(map(re.escape, alphabet))
        #: A character that no piece has; or spaces and the known characters after them.
        self.units = re.compile(f"[^{SPACE}{known}]|{SPACE}*[{known}]+|{SPACE}+", re.DOTALL)
        #: The places at which a word begins: a space after another character, before and after a foreign character.
        self.starts = re.compile(f"(?<=[^{SPACE}]){SPACE}|[^{SPACE}{known}]|(?<=[^{SPACE}{known}])", re.DOTALL)
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self._tabulate()
        #: What each id writes.
        self.written = pa.array([x.replace(SPACE_BYTES, b" ") for x in self.bytes_of], pa.binary())

    # -- words -------------------------------------------------------------------------------

    def merged(self, word: str) -> list[str]:
        """Merge neighbours, best piece first and leftmost of equals, until none forms a piece."""
        parts, score = list(word), self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str | None, right: str) -> bool:
        """True if the two pieces may stand side by side (left None: at the start of a word)."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged((left or "") + right) == ([right] if left is None else [left, right])
        return known

    def ids_of(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for part in parts:
            i = self.ids.get(part)
            if i is None:
                out.extend(self.byte_ids[b] for b in part.encode())
            else:
                out.append(i)
        return np.array(out, np.int32).tobytes()

    def _tabulate(self) -> None:
        """Arrays for merging many words at once: piece numbers of characters, and of each two pieces that form one, its rank and number."""
        self.number = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.number[ord(piece)] = i
        order = {x: k for k, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = [
            (self.ids[piece[:k]] << 32 | self.ids[piece[k:]], order[self.scores[piece]], i) for piece, i in self.ids.items() for k in range(1, len(piece)) if piece[:k] in self.ids and piece[k:] in self.ids
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_keys = np.append(table[:, 0], np.int64(2**62))
        self.pair_rank = np.append(table[:, 1], NEVER).astype(np.int32)
        self.pair_piece = np.append(table[:, 2], -1).astype(np.int32)
        #: ASCII characters that no piece has.
        self.foreign = np.append(self.number[:128] < 0, np.zeros(128, bool))
        self.foreign[0x20] = False

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the tables; the last place for those that form no piece."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.searchsorted(self.pair_keys[:-1], keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def merge_words(self, codes: np.ndarray) -> np.ndarray:
        """merged() for many words at once: rows of piece numbers that end in -1, before and after."""
        out, alive, columns = np.full_like(codes, -1), np.arange(len(codes)), np.arange(codes.shape[1] - 1)
        place = self._pairs(codes[:, :-1], codes[:, 1:])
        while len(alive):
            rank = self.pair_rank[place]
            at = rank.argmin(1)
            on = rank[np.arange(len(alive)), at] < NEVER
            if not on.all():
                out[alive[~on]] = codes[~on]
                alive, codes, place, at = alive[on], codes[on], place[on], at[on]
            rows = np.arange(len(alive))
            # the piece takes the place of the left one; what follows moves up
            after = np.minimum(columns + (columns >= at[:, None]), columns[-1])
            codes[rows, at] = self.pair_piece[place[rows, at]]
            codes[:, 1:] = np.take_along_axis(codes[:, 1:], after, 1)
            place = np.take_along_axis(place, after, 1)
            place[rows, at] = self._pairs(codes[rows, at], codes[rows, at + 1])
            inner = np.flatnonzero(at)
            left = at[inner] - 1
            place[inner, left] = self._pairs(codes[inner, left], codes[inner, left + 1])
        return out

    def words(self, spelled: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words (spelled in bytes with plain spaces): all ids, where each word's begin, and how many they are."""
        ends = np.frombuffer(spelled.buffers()[1], np.int32, len(spelled) + 1, 4 * spelled.offset)
        data = np.frombuffer(spelled.buffers()[2], np.uint8, int(ends[-1]))[ends[0] :]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        codes = np.where(points == 0x20, self.number[ord(SPACE)], self.number[points])
        begins = np.cumsum((data & 0xC0) != 0x80)[ends[:-1] - ends[0]] - 1  # in characters
        sizes = np.diff(np.append(begins, len(codes)))
        slow = (np.add.reduceat(codes < 0, begins) > 0) | (sizes > SHORT)
        at, counts, pools, total = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.int64), [], 0
        for low, high in ((0, 6), (6, 10), (10, 16), (16, SHORT)):
            every, columns = np.flatnonzero((sizes > low) & (sizes <= high) & ~slow), np.arange(high + 1)
            for k in range(0, len(every), WORDS):
                mine = every[k : k + WORDS]
                made = self.merge_words(np.where(columns < sizes[mine][:, None], codes[np.minimum(begins[mine][:, None] + columns, len(codes) - 1)], -1))
                kept = made >= 0
                counts[mine] = kept.sum(1)
                at[mine] = total + np.cumsum(counts[mine]) - counts[mine]
                pools.append(made[kept])
                total += len(pools[-1])
        for i in np.flatnonzero(slow).tolist():
            parts = self.units.findall(spelled[i].as_py().decode().replace(" ", SPACE))
            ids = b"".join(self.ids_of(self.merged(x) if len(x) <= SHORT else self.path(x, [(0, 0, None)], len(x), None)) for x in parts)
            pools.append(np.frombuffer(ids, np.int32))
            at[i], counts[i] = total, len(pools[-1])
            total += len(pools[-1])
        return np.concatenate(pools), at, counts

    def encode_flat(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts side by side in data, each from its place in begins on, and the ids before each place.

        A text is cut before each space that follows another byte and around foreign bytes; each distinct part of a
        block is looked up once.
        """
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(begins), np.int32)
        first, foreign = data == 0x20, self.foreign[data]
        first[1:] &= ~first[:-1]
        first |= foreign
        first[1:] |= foreign[:-1]
        first[begins[begins < len(data)]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        pool, at, sizes = self.words(parts.dictionary)
        which = parts.indices.to_numpy()
        each = sizes[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = pool[np.repeat(at[which] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, begins)].astype(np.int32)

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that these ids write, and the bytes before each of them."""
        taken = self.written.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)
        return np.frombuffer(taken.buffers()[2] or b"", np.uint8, int(ends[-1])), ends

    def encode_words(self, text: str) -> bytes:
        """Ids of a text in the model's writing that begins and ends at word boundaries."""
        return self.encode_flat(np.frombuffer(text.encode().replace(SPACE_BYTES, b" "), np.uint8), np.zeros(1, np.int64))[0].tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_words(SPACE + text) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        text = self.decode_flat(ids)[0].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    # -- chunks ------------------------------------------------------------------------------

    def states(self, text: str, cut: int) -> list[State]:
        """Pieces (start, end) of the text that cover the character before the cut."""
        found = []
        for start in range(max(0, cut - self.reach), cut):
            for end in range(cut, min(len(text), start + self.reach) + 1):
                if end == start + 1 or text[start:end] in self.ids:
                    found.append((start, end))
        return found

    def forward(self, text: str, entries: list[tuple[int, int, str | None]], stop: int) -> tuple[dict, dict]:
        """Nodes (start, end) reached from entries (start, end, piece), as bit sets of entries, with the node before each.

        Walks to the nodes that end at or after ``stop``.
        """
        reached: dict[int, dict[State, int]] = {}
        pieces: dict[State, str | None] = {}
        before: dict[State, State] = {}
        over: dict[State, int] = {}
        for i, (start, end, piece) in enumerate(entries):
            node = (start, end)
            pieces[node] = piece
            at = over if end >= stop and piece is not None else reached.setdefault(end, {})
            at[node] = at.get(node, 0) | 1 << i
        while reached:
            place = min(reached)
            nodes = reached.pop(place)
            for end in range(place + 1, min(len(text), place + self.reach) + 1):
                piece = text[place:end]
                if end > place + 1 and piece not in self.ids:
                    continue
                got, node = 0, (place, end)
                for left, bits in nodes.items():
                    if self.fits(pieces[left], piece):
                        got |= bits
                        before[node] = left
                if got:
                    pieces[node] = piece
                    at = over if end >= stop else reached.setdefault(end, {})
                    at[node] = at.get(node, 0) | got
        return over, before

    def path(self, text: str, entries: list[tuple[int, int, str | None]], stop: int, last: State | None) -> list[str]:
        """Pieces after the one entry up to the node ``last`` (None: the node that ends at ``stop``)."""
        over, before = self.forward(text, entries, stop)
        node = last or next(x for x in over if x[1] == stop)
        first, found = entries[0][:2], []
        while node != first:
            found.append(text[node[0] : node[1]])
            node = before[node]
        return found[::-1]

    def boundaries(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and the last place in [begin, end) at which a word begins; None if there is none."""
        first = self.starts.search(text, begin, end)
        if first is None:
            return None
        low = high = first.start()
        for k in range(end - 1, low, -1):
            if self.starts.match(text, k):
                high = k
                break
        return low, high


class Chunk:
    """A part [begin, end) of a text with the characters around it that a piece may reach."""

    def __init__(self, codec: Codec, text: str, begin: int, end: int, first: bool, last: bool):
        self.codec, self.text, self.begin, self.end = codec, text, begin, end
        self.left = [(begin, begin)] if first else codec.states(text, begin)
        self.right = [] if last else codec.states(text, end)
        self.first, self.last = first, last
        self.words = codec.boundaries(text, begin, end)
        if first:
            self.words = (begin, self.words[1] if self.words else begin)

    def entry(self, state: State) -> tuple[int, int, str | None]:
        return (*state, None if self.first else self.text[state[0] : state[1]])

    def matrix(self) -> np.ndarray:
        """Max-plus matrix from the left to the right states: 0 where a path of compatible pieces leads, else -inf."""
        out = np.full((len(self.left), len(self.right) or 1), -np.inf, np.float32)
        entries, start = [self.entry(x) for x in self.left], None
        if self.words and not self.first:
            # all paths meet at the first word, so the last word alone decides what follows
            met = [bits for node, bits in self.codec.forward(self.text, entries, self.words[0])[0].items() if node[1] == self.words[0]]
            start = [i for i in range(len(entries)) if any(bits >> i & 1 for bits in met)]
        if self.words:
            over = self.codec.forward(self.text, [(self.words[1], self.words[1], None)], self.end)[0]
            rows = {node: start if start is not None else [0] for node in over}
        else:
            over = self.codec.forward(self.text, entries, self.end)[0]
            rows = {node: [i for i in range(len(entries)) if bits >> i & 1] for node, bits in over.items()}
        for node, reached in rows.items():
            if self.last:
                out[reached, 0] = 0
            elif node in self.right:
                out[reached, self.right.index(node)] = 0
        return out

    def trace(self, left: int, right: int) -> bytes:
        """Ids of the pieces after the left state, up to and with the right one."""
        codec, entry = self.codec, self.entry(self.left[left])
        final = None if self.last else self.right[right]
        if not self.words:
            return codec.ids_of(codec.path(self.text, [entry], self.end, final))
        low, high = self.words
        head = [] if self.first else codec.path(self.text, [entry], low, None)
        tail = codec.path(self.text, [(high, high, None)], self.end, final)
        return codec.ids_of(head) + codec.encode_words(self.text[low:high]) + codec.ids_of(tail)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by an associative scan of logarithmic depth."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = prefixes([times(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    out = []
    for i, m in enumerate(matrices):
        out.append(m if i == 0 else pairs[i // 2] if i % 2 else times(pairs[i // 2 - 1], m))
    return out


def chosen(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The left and right state of each chunk on the one path of weight 0."""
    before = prefixes(matrices)
    right = [0] * len(matrices)
    for k in range(len(matrices) - 1, 0, -1):
        # the state at the cut from which the rest can be finished
        right[k - 1] = int(np.argmax(before[k - 1][0] + matrices[k][:, right[k]]))
    return [(right[k - 1] if k else 0, right[k]) for k in range(len(matrices))]


def _codec(name: str, held: dict = {}) -> Codec:  # noqa: B006  one codec for all tasks of a Python worker
    path = SparkFiles.get(name)
    if path not in held:
        held.clear()
        held[path] = Codec(path)
    return held[path]


def _plain(text: bytes) -> bytes:
    """A text as the model can give it back."""
    return text.replace(SPACE_BYTES, b" ")


def _digest(text: bytes) -> str:
    return hashlib.sha256(_plain(text)).hexdigest()


ENCODED = "doc_id long, ids array<int>, n_tokens int, n_chunks int, text_sha256 string"
CHECKED = "doc_id long, ids array<int>, n_tokens int, n_chunks int, exact boolean"
CHUNKS = pa.schema([("own", pa.string()), ("doc_id", pa.int64()), ("digest", pa.string()), ("k", pa.int32()), ("n", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("part", pa.string())])


def _whole(name: str, check: bool):
    """Kernel over (doc_id, text): the ids of whole texts, with check decoded again and compared, else with the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            for part in parts_of(batch, BLOCK):
                texts = [_plain(x) for x in byte_rows(part)]
                data = np.frombuffer(b"".join([b" " + x if x else b"" for x in texts]), np.uint8)
                begins = np.concatenate(([0], np.cumsum([len(x) + bool(x) for x in texts])))
                ids, ends = codec.encode_flat(data, begins)
                if check:
                    again, upto = codec.decode_flat(ids)
                    at = upto[ends]
                    if np.array_equal(again, data):
                        told = at == begins
                        told = pa.array(told[1:] & told[:-1])
                    else:
                        told = pa.array([np.array_equal(again[at[i] : at[i + 1]], data[begins[i] : begins[i + 1]]) for i in range(len(texts))])
                else:
                    told = pa.array([hashlib.sha256(x).hexdigest() for x in texts])
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(np.diff(ends)), pa.array(np.ones(len(texts), np.int32)), told]
                yield pa.record_batch(columns, ["doc_id", "ids", "n_tokens", "n_chunks", "exact" if check else "text_sha256"])

    return run


def _by_rows(kernel):
    """mapInArrow function that hands a kernel a few rows at a time, since each holds much text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                yield kernel(batch.slice(k, ROWS))

    return run


def _encoded(df: DataFrame, doc_id: str, text: str, model: str, chunk: int, check: bool) -> DataFrame:
    spark = df.sparkSession
    name = distribute(spark, model)
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = _codec(name).reach
        for batch in batches:
            for k in range(batch.num_rows):
                (i,), (x,) = (c.to_pylist() for c in batch.slice(k, 1).columns)
                own_name, digest, x = uuid.uuid4().hex, _digest(x.encode()), SPACE + x.replace(" ", SPACE)
                cuts = [*range(0, len(x), chunk), len(x)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    low = max(0, a - 2 * reach)
                    row = [own_name], [i], [digest], [k], [len(cuts) - 1], [a - low], [b - low], [x[low : b + 2 * reach]]
                    yield pa.record_batch([pa.array(v, t.type) for v, t in zip(row, CHUNKS, strict=True)], schema=CHUNKS)

    def made(row: dict) -> Chunk:
        return Chunk(_codec(name), row["part"], row["begin"], row["end"], row["k"] == 0, row["k"] == row["n"] - 1)

    def transfer(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [made(r).matrix() for r in batch.to_pylist()]
        return pa.record_batch([batch.column("own"), batch.column("k"), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], ["own", "k", "height", "matrix"])

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        found = [np.frombuffer(m, np.float32).reshape(h, -1) for h, m in zip(group.column("height").to_pylist(), group.column("matrix").to_pylist(), strict=True)]
        ends = chosen(found)
        return pa.table({"own": group.column("own"), "k": group.column("k"), "l": pa.array([a for a, _ in ends], pa.int32()), "r": pa.array([b for _, b in ends], pa.int32())})

    def traced(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [made(r).trace(r["l"], r["r"]) for r in batch.to_pylist()]
        ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
        return pa.record_batch([batch.column(c) for c in ("own", "doc_id", "digest", "k", "n")] + [lists], ["own", "doc_id", "digest", "k", "n", "ids"])

    small = own.filter(F.length("text") <= chunk).mapInArrow(_whole(name, check), CHECKED if check else ENCODED)
    giant = own.filter(F.length("text") > chunk)
    # the names of the giants are drawn once, so the chunks are written before they are read twice
    chunks, _ = stash(giant.mapInArrow(split, "own string, doc_id long, digest string, k int, n int, begin int, end int, part string"))
    states = chunks.mapInArrow(_by_rows(transfer), "own string, k int, height int, matrix binary").groupBy("own").applyInArrow(scan, "own string, k int, l int, r int")
    parts = chunks.join(states, ["own", "k"]).mapInArrow(_by_rows(traced), "own string, doc_id long, digest string, k int, n int, ids array<int>")
    joined = parts.groupBy("own", "doc_id", "digest", "n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    giants = joined.select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.col("n").alias("n_chunks"), F.col("digest").alias("text_sha256"))
    return small.unionByName(decode_documents(giants, model).drop("text") if check else giants)


def encode_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, n_tokens, n_chunks, text_sha256) for every row; the digest is of the text that decoding should give."""
    return _encoded(df, doc_id, text, model, chunk, False)


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, n_tokens, n_chunks, exact) for every row: exact if the ids, decoded, give the text again."""
    return _encoded(df, doc_id, text, model, chunk, True)


def distribute(spark: SparkSession, model: str) -> str:
    """Hand the model file to all executors; its name for SparkFiles."""
    name = os.path.basename(model)
    if name not in os.listdir(SparkFiles.getRootDirectory()):
        spark.sparkContext.addFile(os.path.realpath(model))
    return name


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, n_chunks, text, exact): the ids' text, and whether it is the text that was encoded."""
    name = distribute(encoded.sparkSession, model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, lists = _codec(name), batch.column(1)
        texts = [codec.decode(x.values.to_numpy()) for x in lists]
        exact = [hashlib.sha256(x.encode()).hexdigest() == d for x, d in zip(texts, batch.column(4).to_pylist(), strict=True)]
        return pa.record_batch([batch.column(0), lists, batch.column(2), batch.column(3), pa.array(texts, pa.string()), pa.array(exact)], ["doc_id", "ids", "n_tokens", "n_chunks", "text", "exact"])

    rows = encoded.select("doc_id", "ids", "n_tokens", "n_chunks", "text_sha256")
    return rows.mapInArrow(_by_rows(kernel), "doc_id long, ids array<int>, n_tokens int, n_chunks int, text string, exact boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and whether they decode to it again."""
    return round_trip(table(spark, sf_dir, "documents"))
