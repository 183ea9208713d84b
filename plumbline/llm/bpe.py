"""BPE encoding by backtracking and decoding by an offset table.

The tokenizer file is read on the driver and its tables go to the executors in a broadcast, whose size is that of the
vocabulary. A word is encoded in time linear in its length: one Aho-Corasick pass gives the longest token at each
place, and a token is kept only if it is compatible with the one before, that is, if merging the two strings together
would give just these two. Where nothing fits, the encoder gives back its last token and tries a shorter one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from . import workspace
from .tokens import give_back, slices, text_slices

#: White space as Unicode has it (str.split() also splits at U+001C to U+001F).
SPACES = "\t-\r \x85\xa0  -     　"
SPACE_RUN = re.compile(f"[{SPACES}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Marks the last symbol of a word, in place of the suffix of the vocabulary file.
LAST = 0xE000
#: Pieces of letters whose tokens an encoder keeps: so many characters of new ones before those go that were not met
#: again since the last time, and none longer than this.
CACHED_CHARS, CACHED_LENGTH = 1_000_000, 64
#: Bytes of text, about, and texts that are encoded at once, and tokens that are decoded at once.
SLICE_BYTES, SLICE_TEXTS, SLICE_TOKENS = 3 << 20, 10_000, 1_000_000


def byte_symbols() -> list[str]:
    """The symbol of each byte value: itself if printable in Latin-1, else the next free one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Tables:
    """What encoder and decoder need of a tokenizer file: tokens, merges, pattern, special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or spec["decoder"]:
            raise ValueError("a byte-level BPE file with word ends and without decoder is needed")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizers: {kinds}")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"]
        inner = lambda s: s[: -len(suffix) - 1] + chr(LAST + ord(s[-len(suffix) - 1])) if s.endswith(suffix) and s != suffix else s
        self.names = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for s, i in (model["vocab"] | self.special).items():
            self.names[i] = s
        self.ids = {inner(s): i for s, i in model["vocab"].items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = self.ids[inner(a)], self.ids[inner(b)]
            self.merges[left, right] = rank, self.ids[inner(a) + inner(b)]
        self.canonical = self._canonical()

    def _canonical(self) -> list[str]:
        """The tokens that merging makes of their own string; no text yields another."""
        made = {whole for _, whole in self.merges.values()}
        return [s for s, i in self.ids.items() if i not in made or self.merge(s) == [i]]

    def merge(self, symbols: str) -> list[int]:
        """BPE as it is defined: the earliest merge first. For single tokens and tests."""
        ids = [self.ids[c] for c in symbols]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 60,))[0], k) for k, p in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                break
            k = best[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids


class Encoder:
    def __init__(self, tables: Tables):
        import ahocorasick
        import regex

        self.pieces = regex.compile(tables.pattern)
        self.special = tables.special
        self.special_re = re.compile("|".join(map(re.escape, sorted(tables.special, key=len, reverse=True))) or "(?!)")
        self.symbols = byte_symbols()
        self.ids, self.merges = tables.ids, tables.merges
        self.length = [0] * len(tables.names)
        for s in tables.canonical:
            self.length[tables.ids[s]] = len(s)
        self.rank = {whole: rank for rank, whole in tables.merges.values()}
        self.parts = {whole: pair for pair, (_, whole) in tables.merges.items()}
        known = set(tables.canonical)
        self.shorter: list[int | None] = [None] * len(tables.names)
        self.automaton = ahocorasick.Automaton()
        for s in tables.canonical:
            self.automaton.add_word(s, tables.ids[s])
            cut = next((s[:n] for n in range(len(s) - 1, 0, -1) if s[:n] in known), None)
            self.shorter[tables.ids[s]] = tables.ids[cut] if cut else None
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0  # characters in recent

    def fits(self, left: int, right: int) -> bool:
        """Whether the strings of two tokens, put together, merge to just these two. Walks down the seam: the merge of
        a pair at the seam must not come before that which made the later of the two parts. Answers are kept, which
        makes the pair table."""
        if (left, right) in self.compatible:
            return self.compatible[left, right]
        a, b, made_a, made_b, good = left, right, None, None, True
        while True:
            # a and b meet at the seam until the merge made_a takes a (or made_b takes b), whichever is earlier
            until = min((r, w) for r, w in ((made_a, 0), (made_b, 1), (1 << 60, 2)) if r is not None)
            seam = self.merges.get((a, b))
            # of equal ranks the one further left comes first, and a's is the further left
            if seam and (seam[0] < until[0] or seam[0] == until[0] and until[1] == 1):
                good = False
                break
            ranks = self.rank.get(a, -1), self.rank.get(b, -1)
            if ranks == (-1, -1):
                break
            if ranks[0] >= ranks[1]:
                made_a, a = ranks[0], self.parts[a][1]
            else:
                made_b, b = ranks[1], self.parts[b][0]
        if len(self.compatible) >= 200_000:
            self.compatible.clear()
        self.compatible[left, right] = good
        return good

    def encode_symbols(self, word: str) -> list[int]:
        n, length, compatible = len(word), self.length, self.compatible
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(word):
            longest[end - length[token]] = token  # one before its start; of those with one start the longest comes last
        token = longest[-1]
        if length[token] == n:
            return [token]
        out: list[int] = []
        dead, at, last = None, 0, None
        while True:
            while token is not None:
                end = at + length[token]
                if dead is None or not dead[end]:
                    if last is None:
                        break
                    good = compatible.get((last, token))
                    if self.fits(last, token) if good is None else good:
                        break
                token = self.shorter[token]
            if token is None:  # nothing goes on from here: give the last token back
                dead = dead or bytearray(n + 1)
                dead[at] = 1
                out.pop()
                at -= length[last]
                token = self.shorter[last]
            else:
                out.append(token)
                if end == n:
                    return out
                at = end
                token = longest[at - 1]
            last = out[-1] if out else None

    def encode_piece(self, piece: str) -> list[int]:
        shown = piece.isascii() and piece.isprintable()
        symbols = piece if shown else "".join([self.symbols[b] for b in piece.encode()])
        return self.encode_symbols(symbols[:-1] + chr(LAST + ord(symbols[-1])))

    def encode_letters(self, piece: str) -> tuple[int, ...]:
        """A piece of letters only, kept because it comes with all kinds of marks around it and in many texts."""
        got = self.recent.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                got = tuple(self.encode_piece(piece))
            if len(piece) <= CACHED_LENGTH:
                if self.held >= CACHED_CHARS:
                    self.older, self.recent, self.held = self.recent, {}, 0
                self.recent[piece] = got
                self.held += len(piece)
        return got

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """A stretch of normalised text without white space and special tokens."""
        if chunk.isalpha():
            return self.encode_letters(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return *self.encode_letters(chunk[:-1]), *self.encode_piece(chunk[-1])
        out: list[int] = []
        for piece in self.pieces.findall(chunk):
            out += self.encode_letters(piece) if piece.isalpha() else self.encode_piece(piece)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """One text, special tokens included."""
        if not text:
            return []
        out: list[int] = []
        at = 0
        for m in self.special_re.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for chunk in SPACE_RUN.split(normalised(text)) if chunk for i in self.encode_chunk(chunk)]

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """The tokens of each text. Each distinct stretch between white space is encoded once; texts with special tokens
        or with separators that are no white space to the tokenizer go one by one."""
        strings = [x or "" for x in texts.to_pylist()]
        odd = [k for k, x in enumerate(strings) if self.special_re.search(x) or ODD_SPACE.search(x)]
        alone = {k: self.encode(strings[k]) for k in odd}
        plain = pa.array(["" if k in alone else normalised(x) for k, x in enumerate(strings)], pa.string())
        chunks = pc.utf8_split_whitespace(plain)
        ends = chunks.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(chunks.flatten())
        word = coded.indices.to_numpy().astype(np.int64)
        made = [self.encode_chunk(x) if x else () for x in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int32, int(size.sum()))
        n = size[word]  # tokens of each stretch of the texts
        upto = np.concatenate([[0], n.cumsum()])
        ids = flat[np.repeat(size.cumsum()[word] - n - upto[:-1], n) + np.arange(upto[-1])] if len(word) else flat
        found = pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(ids, pa.int32()))
        if not alone:
            return found
        place = np.arange(len(strings))
        place[odd] = len(strings) + np.arange(len(odd))
        return pa.concat_arrays([found, pa.array([alone[k] for k in odd], pa.list_(pa.int32()))]).take(pa.array(place))


def normalised(text: str) -> str:
    """The normal form of the tokenizer but for runs of white space; sigma has one lower case wherever it stands."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Decoder:
    """Token strings in one piece with the offset of each, which is what an Arrow string array is, so that decoding is
    a look-up. Without a decoder in its file the tokenizer puts a space between tokens."""

    def __init__(self, names: list[str]):
        self.names = pa.array(names, pa.large_string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of tokens; of none for a null list."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type))
        ends = ids.offsets.to_numpy().astype(np.int64)
        strings = pa.LargeListArray.from_arrays(pa.array(ends - ends[0]), self.names.take(ids.flatten()))
        return pc.binary_join(strings, pa.scalar(" ", pa.large_string()))


@dataclass(frozen=True)
class Shared:
    """Broadcasts of a tokenizer's tables, for encoding, and of its token names, for decoding."""

    tables: Broadcast
    names: Broadcast


def load(spark: SparkSession, path: str) -> Shared:
    """The tokenizer file at path (on the driver), broadcast."""
    workspace.small_batches(spark)
    with open(path, encoding="utf-8") as f:
        tables = Tables(f.read())
    return Shared(spark.sparkContext.broadcast(tables), spark.sparkContext.broadcast(tables.names))


def encode(df: DataFrame, shared: Shared, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids (array<int>) of column text in column ids; a column of that name is replaced. A null or
    empty text has no tokens. Special tokens written out in a text count as such; none are added."""
    keep = [c for c in df.columns if c != ids]
    schema = df.select(*keep).schema.add(ids, ArrayType(IntegerType()))
    tables = shared.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)  # as long as the task: workers that wait for other work hold nothing
        for batch in text_slices(batches, text, SLICE_BYTES, SLICE_TEXTS):
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, encoder.encode_all(batch.column(text))], [*keep, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, shared: Shared, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the token ids in column ids, special tokens included; null ids count as none."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).schema.add(text, "string")
    names = shared.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(names.value)
        for whole in batches:
            n = pc.fill_null(pc.list_value_length(whole.column(ids)), 0).to_numpy().astype(np.int64)
            for batch in slices(whole, n, SLICE_TOKENS):
                made = decoder.decode_all(batch.column(ids)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, made], [*keep, text])
            give_back()

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, shared: Shared, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() of its ids in one pass, so that a task needs one Python worker and the ids don't go back."""
    keep = [c for c in df.columns if c not in (ids, decoded)]
    schema = df.select(*keep).schema.add(ids, ArrayType(IntegerType())).add(decoded, "string")
    tables = shared.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(tables.value), Decoder(tables.value.names)
        for batch in text_slices(batches, text, SLICE_BYTES, SLICE_TEXTS):
            made = encoder.encode_all(batch.column(text))
            back = decoder.decode_all(made).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, made, back], [*keep, ids, decoded])

    return df.mapInArrow(run, schema)
