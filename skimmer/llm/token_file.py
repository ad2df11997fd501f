"""Token ids in a binary file, coded by a static range asymmetric numeral system.

A token file is a folder of Parquet files whose rows are segments in order: part, segment, number of tokens and a payload.
A payload holds one frequency table, shared by its blocks, the ids and lengths of its documents, and blocks of BLOCK tokens
coded on LANES interleaved states. Each block has a checkpoint (where its words start, the states to begin from) and a
checksum of its ids, so any block can be decoded alone given the table; all blocks of a segment are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skimmer.llm.common import chunks, mix, scratch_path, table

LANES, BLOCK, SEGMENT = 32, 4096, 1 << 21
STEPS = BLOCK // LANES
MAGIC = b"SKRANS01"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, frequencies that sum to 2**scale, scale); each symbol there gets one at least."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    scale = max(16, int(len(symbols)).bit_length() + 1)
    f = np.maximum(1, counts * (1 << scale) // counts.sum())
    over = int(f.sum()) - (1 << scale)
    while over > 0:  # rare symbols were raised to one: the most frequent ones give
        give = np.minimum(f // 2, -(-over * f // f.sum()))
        give = np.minimum(np.cumsum(give), over) - np.minimum(np.cumsum(give) - give, over)
        f -= give
        over -= int(give.sum())
    f[np.argmax(f)] -= over
    return symbols.astype(np.uint32), f.astype(np.uint64), scale


def _state(scale: int) -> str:
    return "<u4" if scale <= 16 else "<u8"  # a state has scale + 16 bits


def _kind(scale: int, f: np.ndarray):
    """The numbers to reckon in: 32 bits hold all states unless one symbol has the whole range."""
    return np.uint32 if scale <= 16 and f.max() < 1 << 16 else np.uint64


def encode(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """One segment. ids: all tokens of its documents; doc_ids may hold None."""
    symbols, f, scale = frequencies(ids)
    kind = _kind(scale, f)
    f = f.astype(kind)
    start = (np.cumsum(f) - f).astype(kind)
    blocks = -(-len(ids) // BLOCK)
    sym = np.full(blocks * BLOCK, int(np.argmax(f)), np.int64)  # the last block is filled up with the cheapest symbol
    index = np.zeros(int(symbols[-1]) + 1, np.int64)
    index[symbols] = np.arange(len(symbols))
    sym[: len(ids)] = index[ids]
    sym = np.ascontiguousarray(sym.reshape(blocks, STEPS, LANES).transpose(1, 0, 2))
    x = np.full((blocks, LANES), 1 << scale, kind)
    words, out = np.zeros((STEPS, blocks, LANES), np.uint16), np.zeros((STEPS, blocks, LANES), bool)
    sixteen, shift = kind(16), kind(scale)
    for t in range(STEPS - 1, -1, -1):
        g = f[sym[t]]
        big = x >= (g << sixteen)
        words[t] = x  # the low sixteen bits; kept where big
        out[t] = big
        x = np.where(big, x >> sixteen, x)
        q = x // g
        x = (q << shift) + (x - q * g) + start[sym[t]]
    out = out.transpose(1, 0, 2)
    stream = words.transpose(1, 0, 2)[out]
    sizes = out.sum(axis=(1, 2)).astype(np.uint32)
    checks = np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], np.uint32)
    null = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    head = struct.pack("<8sBIIIQ", MAGIC, scale, len(symbols), blocks, len(doc_ids), len(ids))
    parts = [head, symbols.astype("<u4"), f.astype("<u4"), named, null, lengths.astype("<i8"), sizes.astype("<u4"), checks.astype("<u4"), x.astype(_state(scale)), stream.astype("<u2")]
    body = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A payload's tables, checked against its checksum; ``blocks`` decodes any of its blocks."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC or zlib.crc32(memoryview(payload)[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a segment, or a damaged one")
        _, self.scale, n_symbols, self.n_blocks, n_docs, self.n = struct.unpack_from("<8sBIIIQ", payload)
        at = struct.calcsize("<8sBIIIQ")

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(payload, kind, count, at)
            at += got.nbytes
            return got

        self.symbols, f = take("<u4", n_symbols), take("<u4", n_symbols)
        self.kind = _kind(self.scale, f)
        self.f = f.astype(self.kind)
        self.named, self.null, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
        self.sizes, self.checks = take("<u4", self.n_blocks).astype(np.int64), take("<u4", self.n_blocks)
        self.states = take(_state(self.scale), self.n_blocks * LANES).reshape(self.n_blocks, LANES)
        self.stream = take("<u2", int(self.sizes.sum()))

    def doc_ids(self) -> list:
        return [None if z else int(d) for d, z in zip(self.named, self.null)]

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of blocks first .. end - 1, each from its own checkpoint; ValueError if a checksum fails."""
        kind, f, scale, many = self.kind, self.f, self.scale, end - first
        x = self.states[first:end].astype(kind)
        start = (np.cumsum(f) - f).astype(kind)
        slots = np.repeat(np.arange(len(f), dtype=np.int32), f.astype(np.int64))
        at_word = (np.cumsum(self.sizes) - self.sizes)[first:end]
        out = np.zeros((STEPS, many, LANES), np.int32)
        low, shift, sixteen, mask = kind(1 << scale), kind(scale), kind(16), kind((1 << scale) - 1)
        for t in range(STEPS):
            slot = x & mask
            s = out[t] = slots[slot.astype(np.int64)]
            x = f[s] * (x >> shift) + slot - start[s]
            need = x < low
            where = (at_word[:, None] + np.cumsum(need, axis=1) - 1)[need]
            x[need] = (x[need] << sixteen) | self.stream[where]
            at_word = at_word + need.sum(axis=1)
        ids = self.symbols[out.transpose(1, 0, 2).ravel()[: self.n - first * BLOCK]]
        for b in range(many):
            if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != self.checks[first + b]:
                raise ValueError(f"block {first + b} is damaged")
        return ids


def decode(payload: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids, doc_ids, lengths) of a segment; ValueError if a checksum fails."""
    segment = Segment(payload)
    return segment.blocks(0, segment.n_blocks), segment.doc_ids(), segment.lengths


def crc32_joined(a: int, b: int, size: int) -> int:
    """The crc32 of two byte strings in a row, from that of each and the second one's size."""

    def times(x: int, y: int) -> int:  # polynomials over two elements, lowest power in the highest bit
        out = 0
        for bit in range(31, -1, -1):
            if x >> bit & 1:
                out ^= y
            y = y >> 1 ^ (0xEDB88320 if y & 1 else 0)
        return out

    power, square, n = 1 << 31, 1 << 23, size  # x**0 and x**8
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(power, a) ^ b


LONGEST = 31  # bytes of a part that is kept: with its length it fills four words
_MASKS = np.array([[((1 << 8 * min(max(n - 8 * w, 0), 8)) - 1) for w in range(4)] for n in range(LONGEST + 1)], np.uint64)
_MASKS_LENGTH = np.arange(LONGEST + 1, dtype=np.uint64) << np.uint64(56)


class Known:
    """Parts and their ids: an open hash table in arrays, looked up and filled many keys at a time. Keys are compared in full."""

    def __init__(self, most: int, more: int):
        """most: entries beyond which it is cleared; more: how many may still come before that."""
        self.most, self.size = most, 1 << (2 * (most + more)).bit_length()
        self.clear()

    def clear(self) -> None:
        self.n, self.used, self.slots = 0, 0, np.full(self.size, -1, np.int32)
        self.keys = np.zeros((1024, 4), np.uint64)
        self.at, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0].copy()
        for w in range(1, 4):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + keys[:, w]
        return mix(h)

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for none."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        slot = (h & np.uint64(self.size - 1)).astype(np.int64)
        while len(left):
            entry = self.slots[slot[left]]
            left, entry = left[entry >= 0], entry[entry >= 0]
            same = (self.keys[entry] == keys[left]).all(axis=1)
            out[left[same]] = entry[same]
            left = left[~same]
            slot[left] = (slot[left] + 1) & (self.size - 1)
        return out

    def add(self, keys: np.ndarray, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New and distinct keys with their ids, one after another."""
        n, used = self.n + len(keys), self.used + len(ids)
        grown = lambda x, to: x if len(x) >= to else np.concatenate([x, np.zeros((max(to, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])
        self.keys, self.at, self.count, self.ids = grown(self.keys, n), grown(self.at, n), grown(self.count, n), grown(self.ids, used)
        self.keys[self.n : n], self.count[self.n : n], self.ids[self.used : used] = keys, count, ids
        self.at[self.n : n] = self.used + np.cumsum(count) - count
        entry, slot = np.arange(self.n, n, dtype=np.int32), (h & np.uint64(self.size - 1)).astype(np.int64)
        self.n, self.used = n, used
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (self.size - 1)


class Encoder:
    """The tokenizers library's ids of whole texts.

    Its pre-tokenizer never joins what stands before a single space or line feed between non-blank characters with what follows, nor
    a letter or digit with a symbol after it. So texts are cut there into parts (each with the space or line feed before it);
    the ids of parts are kept, up to ``most`` of them, and unknown parts are encoded many in a row and cut apart by the bytes
    that each id stands for. What begins a text is encoded on its own. Texts that hold an added token are encoded whole, as
    the library cuts them at that token first."""

    BLOCK, RUN = 1 << 16, 1 << 16  # parts looked up at a time, bytes encoded at a time

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))  # byte-level: a character stands for a byte
        # The same model behind another door: letters alone need no pattern to be cut by, so words come one a line, their bytes
        # spelled as the vocabulary has them.
        from tokenizers import pre_tokenizers

        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(256 + i) for i, b in enumerate(other)} | {b: chr(b) for b in plain}
        self.spelling[0x20] = "\n" + self.spelling[0x20]
        self.known = Known(most, self.BLOCK)
        self.symbols = np.zeros((256, 2), np.int64)  # a symbol at the end of a part: its id, if it is one
        for c in range(0x21, 0x7F):
            ids = self.raw([chr(c)])[0]
            if not chr(c).isalnum() and len(ids) == 1:
                self.symbols[c] = ids[0], 1

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(array("I", e.ids), np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where parts begin, whether a part is a symbol) in the bytes of some texts; a text's first part begins with it."""
        blank = _BLANKS[data]
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        if len(lead):  # the white space beyond ASCII
            one, two = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
            first = data[lead]
            short = (first == 0xC2) & ((one == 0x85) | (one == 0xA0))
            general = (first == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
            long = general | ((first == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((first == 0xE2) & (one == 0x81) & (two == 0x9F)) | ((first == 0xE3) & (one == 0x80) & (two == 0x80))
            for at, n in ((lead[short], 1), (lead[long], 2)):
                blank[at] = True
                blank[at + n] = True
        edge = np.zeros(len(data) + 1, bool)  # texts begin and end here
        edge[offsets] = True
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-2] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & ~blank[:-2] & ~blank[2:] & ~edge[1:-2] & ~edge[2:-1]
        begin |= edge
        # a symbol after a letter or digit, before the end of its part
        symbol = np.zeros(len(data) + 1, bool)
        symbol[1:-1] = (self.symbols[data[1:], 1] > 0) & _ALNUM[data[:-1]] & begin[2:] & ~edge[1:-1]
        begin |= symbol
        at = np.flatnonzero(begin[:-1])
        return at, symbol[at]

    def run(self, text: bytes) -> np.ndarray:
        """The ids of parts in a row."""
        words = text.decode()
        if text[:1] == b" " and words.replace(" ", "").isalpha():
            spelled = text.decode("latin-1").translate(self.spelling)
            (found,) = self.letters.encode_batch_fast([spelled], add_special_tokens=False)
            return np.array(array("I", found.ids), np.uint32)
        return self.raw([words])[0]

    def fresh_ids(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of parts, encoded in runs: those of letters together, then the rest."""
        take = lambda at, n: data[np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        begin = np.cumsum(lengths) - lengths
        odd = (np.add.reduceat(~_LETTER[take(starts, lengths)], begin, dtype=np.int64) > 1) | (data[starts] != 0x20)
        order = np.argsort(odd, kind="stable")
        ids, count = [], np.zeros(len(starts), np.int64)
        for kind in (order[: len(odd) - int(odd.sum())], order[len(odd) - int(odd.sum()) :]):
            n, text, at = lengths[kind], take(starts[kind], lengths[kind]).tobytes(), 0
            ends = np.cumsum(n)
            while at < len(kind):
                base = int(ends[at] - n[at])
                to = max(at + 1, int(np.searchsorted(ends, base + self.RUN, "right")))
                got = self.run(text[base : int(ends[to - 1])])
                reach = np.cumsum(self.size[got])
                cut = np.searchsorted(reach, ends[at:to] - base)
                if not np.array_equal(reach[cut], ends[at:to] - base):
                    raise ValueError("a token goes on from one part to the next; parts are no unit of this tokenizer")
                count[kind[at:to]] = np.diff(cut + 1, prepend=0)
                ids.append(got)
                at = to
        ids, mine = np.concatenate(ids), count[order]
        first = np.empty(len(order), np.int64)
        first[order] = np.cumsum(mine) - mine
        return ids[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(ids))], count

    def parts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each part) of a block of parts that begin with a space or a line feed."""
        known = self.known
        if known.n > known.most:  # what is common comes back at once
            known.clear()
        short = np.flatnonzero(lengths <= LONGEST)
        padded = np.lib.stride_tricks.sliding_window_view(data, 32)[starts[short]]
        keys = padded.view(np.uint64) & _MASKS[lengths[short]]
        keys[:, 3] |= _MASKS_LENGTH[lengths[short]]
        h = known.hashes(keys)
        entry = np.full(len(starts), -1, np.int64)
        entry[short] = known.find(keys, h)
        lost = np.flatnonzero(entry[short] < 0)
        if len(lost):
            _, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            alike = (keys[lost[first[back]]] == keys[lost]).all(axis=1)  # else two keys share a hash: the later one is looked up again
            new = lost[first]
            ids, count = self.fresh_ids(data, starts[short[new]], lengths[short[new]])
            n = known.n
            known.add(keys[new], h[new], ids, count)
            entry[short[lost[alike]]] = n + back[alike]
        many = np.zeros(len(starts), np.int64)
        some = entry >= 0
        many[some] = known.count[entry[some]]
        rest = np.flatnonzero(~some)  # long ones, and clashes
        if len(rest):
            other, many[rest] = self.fresh_ids(data, starts[rest], lengths[rest])
        end = np.cumsum(many)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.uint32)
        place = lambda to, n: np.repeat(to - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out[place((end - many)[some], many[some])] = known.ids[place(known.at[entry[some]], many[some])]
        if len(rest):
            out[place((end - many)[rest], many[rest])] = other
        return out, many

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each row) of an Arrow string column without nulls."""
        ids, counts = [], []
        for first, data, offsets in chunks(column):
            rows = len(offsets) - 1
            whole = np.zeros(rows, bool)
            text = data.tobytes()
            for a in self.added:
                at = text.find(a.encode())
                while at >= 0:
                    whole[np.searchsorted(offsets, at, "right") - 1] = True
                    at = text.find(a.encode(), at + 1)
            padded = np.concatenate([data, np.zeros(32, np.uint8)])
            at, symbol = self.cuts(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, bool))
            lengths = np.diff(np.append(at, len(data)))
            row = np.searchsorted(offsets, at, "right") - 1
            head = np.isin(at, offsets[:-1]) & ~whole[row]
            plain = np.flatnonzero(~head & ~symbol & ~whole[row])
            many = np.zeros(len(at), np.int64)
            many[symbol & ~whole[row]] = 1
            begins = self.raw([text[a : a + n].decode() for a, n in zip(at[head].tolist(), lengths[head].tolist())])
            many[head] = list(map(len, begins))
            found = []
            for k in range(0, len(plain), self.BLOCK):
                some = plain[k : k + self.BLOCK]
                got, many[some] = self.parts(padded, at[some], lengths[some])
                found.append(got)
            wholes = np.flatnonzero(whole)
            by_library = self.raw([text[offsets[r] : offsets[r + 1]].decode() for r in wholes])
            anchor = np.searchsorted(row, wholes)  # all ids of such a text stand at its first part
            many[anchor] = list(map(len, by_library))
            end = np.cumsum(many)
            out = np.zeros(int(end[-1]) if len(end) else 0, np.uint32)
            place = lambda which: np.repeat((end - many)[which] - np.cumsum(many[which]) + many[which], many[which]) + np.arange(int(many[which].sum()))
            none = np.zeros(0, np.uint32)
            out[place(plain)] = np.concatenate([none, *found])
            out[place(np.flatnonzero(head))] = np.concatenate([none, *begins])
            out[place(anchor)] = np.concatenate([none, *by_library])
            marks = np.flatnonzero(symbol & ~whole[row])
            out[(end - many)[marks]] = self.symbols[data[at[marks]], 0]
            ids.append(out)
            counts.append(np.bincount(row, many, rows).astype(np.int64))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa

        ids, n = self.encode(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []


_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER = np.array([chr(c).isalpha() or c >= 0x80 for c in range(256)])
_ALNUM = np.array([chr(c).isalnum() and c < 0x80 for c in range(256)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder per worker process and file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


COLUMNS = "part int, segment int, n_tokens long, n_docs long, begun boolean, goes_on boolean, payload binary"


def write(docs: DataFrame, path: str, doc_id="doc_id", text="text", tokenizer: str | None = None, end: int = 2, size: int = SEGMENT) -> None:
    """Writes the ids of docs, each text followed by the end id, in ascending order of doc_id (nulls first, ties by the hash
    of the text, then the text). Null texts are empty; repeated rows stay; an empty table gives an empty file. A segment has
    ``size`` tokens, so a long text goes on from segment to segment."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        code, part, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        closing = np.array([end], "<u4").tobytes()
        held, names, lengths, count, begun = [], [], [], 0, False

        def flush(goes_on):
            nonlocal held, names, lengths, count, segment, begun
            payload = encode(np.frombuffer(b"".join(held), "<u4"), names, np.array(lengths, np.int64))
            row = [part, segment, count, len(names), begun, goes_on, payload]
            held, names, lengths, count, segment, begun = [], [], [], 0, segment + 1, goes_on
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in COLUMNS.split(", ")])

        def hold(name, ids):
            nonlocal count
            held.append(ids)
            names.append(name)
            lengths.append(len(ids) // 4)
            count += len(ids) // 4

        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                got, n = code.encode(rows.column(1).cast(pa.large_binary()).fill_null(b""))
                for i, ids in zip(rows.column(0).to_pylist(), np.split(got, np.cumsum(n)[:-1])):
                    left = memoryview(ids.astype("<u4").tobytes() + closing)
                    while count + len(left) // 4 > size:
                        room = 4 * (size - count)
                        hold(i, left[:room])
                        left = left[room:]
                        yield flush(True)
                    hold(i, left)
                    if count == size:
                        yield flush(False)
        if names:
            yield flush(False)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"))  # rows of one id, or of none, are dealt out too
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(run, COLUMNS).write.option("compression", "none").parquet(path)


def _rows(segment: Segment, docs: np.ndarray, with_ids: bool):
    """(doc numbers, begin, length, crc32[, ids]) of some documents of a segment: only their blocks are decoded."""
    ends = np.cumsum(segment.lengths)
    begins = ends - segment.lengths
    if not len(docs):
        return [[], [], [], []] + [[]] * with_ids
    first, last = int(begins[docs[0]]) // BLOCK, -(-int(ends[docs[-1]]) // BLOCK)
    ids = segment.blocks(first, last).astype("<u4")
    each = [ids[a - first * BLOCK : b - first * BLOCK].tobytes() for a, b in zip(begins[docs], ends[docs])]
    return [docs, begins[docs], segment.lengths[docs], [zlib.crc32(x) for x in each]] + [each] * with_ids


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in a token file, decoded segment by segment. The pieces of
    documents that go on from one segment to the next are decoded apart and put together."""
    kinds = "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decoded(cut: bool):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                for i in range(b.num_rows):
                    part, number, begun, goes_on = (b.column(k)[i].as_py() for k in range(4))
                    segment = Segment(b.column(4)[i].as_py())
                    n = len(segment.lengths)
                    ends = sorted(set([0] * begun + [n - 1] * goes_on)) if cut else [slice(int(begun), n - int(goes_on))]
                    names = segment.doc_ids()
                    for e in ends:
                        docs, *rest = _rows(segment, np.arange(n)[e] if isinstance(e, slice) else np.array([e]), with_ids)
                        cols = [pa.array(np.full(len(docs), x, np.int32)) for x in (part, number)] + [pa.array([names[d] for d in docs], pa.int64())]
                        cols += [pa.array(x, pa.int64()) for x in rest[:3]] + [pa.array(x, pa.binary()) for x in rest[3:]]
                        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in kinds.split(", ")])

        return run

    def joined(pieces):
        import pyarrow as pa

        rows = sorted(pieces.to_pylist(), key=lambda r: r["start"])
        out = rows[0] | {"n_tokens": 0, "ids_crc32": 0}
        for r in rows:
            out |= {"ids_crc32": crc32_joined(out["ids_crc32"], r["ids_crc32"], 4 * r["n_tokens"]), "n_tokens": out["n_tokens"] + r["n_tokens"]}
        if with_ids:
            out["ids"] = b"".join(r["ids"] for r in rows)
        return pa.table({c: pa.array([out[c]], pa.binary() if c == "ids" else pa.int64()) for c in names})

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    by_segment = Window.partitionBy("part").orderBy("segment")
    # a cut document is known by the segment where it began
    starts = stored.select("part", "segment", "begun", (F.sum("n_tokens").over(by_segment) - F.col("n_tokens")).alias("within"), F.last(F.when(~(F.col("begun") & F.col("goes_on") & (F.col("n_docs") == 1)), F.col("segment")), True).over(by_segment.rowsBetween(Window.unboundedPreceding, -1)).alias("origin"))
    starts = starts.join(totals.select("part", "before"), "part")
    own = ["part", "segment", "begun", "goes_on", "payload"]

    def placed(rows):
        return rows.join(starts, ["part", "segment"]).withColumn("start", F.col("before") + F.col("within") + F.col("at"))

    whole = placed(stored.select(*own).mapInArrow(decoded(False), kinds)).select(*names)
    cut = placed(stored.where("begun or goes_on").select(*own).mapInArrow(decoded(True), kinds))
    # the first piece of a segment that was begun belongs to its origin, the last one to its own segment
    cut = cut.withColumn("origin", F.when(F.col("begun") & (F.col("at") == 0), F.col("origin")).otherwise(F.col("segment")))
    return whole.unionByName(cut.groupBy("part", "origin").applyInArrow(lambda t: joined(t.select(names)), ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)))


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
