"""BPE encoding and decoding by a contiguous array of adjacent ranks.

A word is a row of part ids and, between each two neighbours, the rank of
their merge. The smallest rank is found by a scan, its right part is deleted
and the two ranks beside it are looked up anew. Words beyond ``SHORT`` parts
keep the same ranks in a heap over linked parts, which gives the same merges in
n log n. Texts are cut into words by Arrow, many at a time, so that Python sees
each different word of some megabytes once; words that were met before come from
a bounded table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut_words, map_arrow, number_words, stretches

SHORT = 128
#: Bits of an id beside its merge's rank, and the rank of a pair that has none.
WIDTH = 20
ID = (1 << WIDTH) - 1
NEVER = 1 << 60
#: Words that a worker keeps; twice as many at most, of about 0.3 KB each.
KEPT = 200_000
#: Longer ones are not kept.
LONGEST = 64
#: The code points with the property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: The alternative of the split pattern that takes runs of letters.
LETTERS = "[\\p{L}]+"
#: Letters on which the libraries need not be compared, and those at which str.split() cuts although they are no white space here.
BEYOND = re.compile("[^\x00-\u024f]")
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if it is visible in Latin-1, else one from U+0100 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in visible else next(free)) for b in range(256)]


def latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Kept(dict):
    """A table of what ``make`` gave for a key. A full table becomes the old one, from which what is asked for again comes back."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def keep_all(self, values: dict) -> None:
        """As keep() of each, the table being as much too large at most as they are many."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self.update(values)


class WordBPE:
    """Encodes and decodes as the file's tokenizer does, without special tokens of its own around the text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.name_table = pa.array([self.names.get(i) for i in range(max(self.names) + 1)], pa.large_string())
        self.is_name = np.array([*(i in self.names for i in range(max(self.names) + 1)), False])
        # the rank above the new id, so that the smallest number is the smallest rank
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), rank << WIDTH | vocab[left + right])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", WHITE))
        # Letters are all that is left between the other kinds of word: with blanks around those, a text's words are its parts between blanks.
        others = [x for x in pattern.replace("\\s", WHITE).split("|") if x != LETTERS]
        self.others = regex.compile("|".join(others))
        self.arrow_others = "|".join(others).replace(WHITE, "\\t-\\r \\x{85}\\x{a0}")
        self.known = Kept(self.word)
        # Libraries differ in their Unicode version: a letter on which they disagree sends its text through the file's own splitter.
        own = Tokenizer.from_file(path)
        self.own_normal, self.own_split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.letters, self.byte_of = letters, {c: b for b, c in enumerate(letters)}
        self.agreed: set[str] = {chr(c) for c in range(0x250)}
        self.odd: set[str] = set()

    def normal(self, text: str) -> str:
        """NFC, lower case letter by letter; white space is left as it is, as the split drops it."""
        if latin1(text):
            return text.lower()  # it is in NFC
        text = unicodedata.normalize("NFC", text)
        low = text.lower()
        if "Σ" in text:  # lower() looks at its neighbours
            low = "".join(map(str.lower, text))
        return low

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not latin1(text) and BEYOND.search(text) and (new := set(text) - self.agreed):
            for c in new - self.odd:
                probe = f"a{c}b{c}{c}1"
                ours = ["".join(self.letters[b] for b in w.encode()) for w in self.words.findall(self.normal(probe))]
                same = ours == [w for w, _ in self.own_split(self.own_normal(probe))]
                (self.agreed if same else self.odd).add(c)
            if new & self.odd:
                return [bytes(self.byte_of[c] for c in w).decode() for w, _ in self.own_split(self.own_normal(text))]
        text = self.normal(text)
        if any(c in text for c in SEPARATORS):
            return self.words.findall(text)
        return self.others.sub(r" \g<0> ", text).split()

    def merge(self, ids: list[int]) -> list[int]:
        """The parts that are left when the pair of least rank, the leftmost of equals, is joined again and again."""
        if len(ids) > SHORT:
            return self.merge_long(ids)
        get = self.merges.get
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i] = best & ID
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> WIDTH, i, ids[i], ids[i + 1], m & ID) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m >> WIDTH, x, ids[x], ids[y], m & ID))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        raw = word.encode()
        ids = self.merge([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]])
        return struct.pack(f"<{len(ids)}I", *ids)

    def cuts(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand at the odd places."""
        return self.cut.split(text) if "<|" in text else [text]

    def words_of(self, text: str) -> list[str]:
        """The words and special tokens of a whole text."""
        return [w for k, piece in enumerate(self.cuts(text)) for w in ([piece] if k % 2 else self.split(piece))]

    def plain(self, text: str) -> bool:
        """Whether Arrow cuts the text as the tokenizer does: no letter beyond those that all libraries agree on, no special token."""
        return "<|" not in text and (latin1(text) or not BEYOND.search(text)) and not any(c in text for c in SEPARATORS)

    def cut_up(self, texts: list[str]) -> Iterator[tuple[list[int], list[str], np.ndarray, np.ndarray]]:
        """(places of some of the texts, their different words, the word's number at each place of their text, each text's end there)."""
        for part in stretches(texts):
            plain = [i for i in part if self.plain(texts[i])]
            odd = sorted(set(part) - set(plain))
            words, counts = cut_words([self.normal(texts[i]) for i in plain], self.arrow_others)
            own = [self.words_of(texts[i]) for i in odd]
            words = pa.concat_arrays([words, pa.array([w for ws in own for w in ws], pa.string())])
            yield plain + odd, *number_words(words, np.concatenate([counts, np.array([len(ws) for ws in own], np.int64)]))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        special = {w: i.to_bytes(4, "little") for w, i in self.special.items()} | {"": b""}
        known = self.known
        return [special[w] if w in special else known[w] for w in words]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        for places, words, number, ends in self.cut_up(texts):
            for i, ids in zip(places, laid_out(self.ids_of(words), number, ends), strict=True):
                out[i] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, rows: list[bytes]) -> Iterator[str]:
        """The text of each row of ids: their names joined by blanks, as the file names no decoder; unknown ids are left out."""
        for part in stretches(rows):
            own = rows[part.start : part.stop]
            ids = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
            real = self.is_name[np.minimum(ids, len(self.is_name) - 1)]
            ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])])]
            named = self.name_table.take(pa.array(ids[real]))
            yield from pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), named), pa.scalar(" ", pa.large_string())).to_pylist()

    def decode(self, ids: list[int]) -> str:
        return next(self.decode_all([struct.pack(f"<{len(ids)}I", *ids)]))


def laid_out(made: list[bytes], number: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of each text, from those of the different words."""
    flat = np.frombuffer(b"".join(made), "<u4")
    sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
    starts = np.cumsum(sizes) - sizes
    size = sizes[number]
    stops = np.cumsum(size)
    ids = flat[np.repeat(starts[number] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
    bounds = np.concatenate([[0], stops])[np.concatenate([[0], ends])].tolist()
    return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, binary) of every row; other columns are not carried.

    A null text counts as empty and gives no ids; a null id stays null. Rows that
    repeat are encoded each, and an empty table gives no rows. A text of any
    length is encoded whole: a task holds an Arrow batch and about STRETCH
    letters, or one longer text, at a time; nothing is shuffled.
    """

    def start():
        bpe = loaded(path)

        def run(batch):
            ids = bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return run

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), start, "doc_id long, ids binary")


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids as encode_texts gives them; null ids give an empty text, and ids that the vocabulary does not have are left out."""

    def start():
        bpe = loaded(path)

        def run(batch):
            texts = list(bpe.decode_all([x or b"" for x in batch.column(1).to_pylist()]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return run

    return map_arrow(rows.select(F.col(id_col).cast("long"), F.col(ids_col)), start, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts are encoded, and the ids decoded, where they are hashed, so that neither leaves its worker.

    Null and empty texts have no tokens and the digests of empty strings; nulls,
    repeated rows and empty tables are as in encode_texts.
    """

    def start():
        bpe = loaded(path)

        def run(batch):
            rows = bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])
            digest = lambda x: hashlib.sha256(x).hexdigest()
            n, ids, texts = [len(x) // 4 for x in rows], [digest(x) for x in rows], [digest(t.encode()) for t in bpe.decode_all(rows)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
