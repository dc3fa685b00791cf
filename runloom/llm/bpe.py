"""Byte-pair encoding of whole texts in pieces that join to the exact result, and decoding."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .columns import map_columns, repeat_rows
from .shingles import slices

BLANKS = b" \t\n\r\x0b\x0c"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
# Longer texts are dealt out to tasks in pieces of about so many bytes.
PIECE = 1 << 16
# Longer stretches without a blank are encoded in halves.
LEAF = 1 << 12
# Tokens on each side of a join that are encoded again at first.
WINDOW = 8
# Distinct words that a task remembers.
MEMORY = 300_000
# Words that are encoded at once.
BLOCK = 1 << 14


class Encoder:
    """A tokenizer in one task, with the parts that exact joins need."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(config)
        self.whole.no_truncation()
        self.whole.no_padding()
        for b in BLANKS:
            if self.ids(f"a{chr(b)}b") != self.ids("a") + self.ids("b"):
                raise ValueError("texts can only be cut at blanks if the tokenizer drops white space")
        self.model = self.whole.model
        if self.model.dropout or self.model.ignore_merges:
            raise ValueError("pieces only join exactly if merges follow their ranks alone")
        self.suffix = self.model.end_of_word_suffix or ""
        added = self.whole.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must match their plain text")
        names = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.forget()

    def ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def text(self, token: int) -> str:
        """The bytes of a token, one letter each, without the mark of a word's end."""
        name = self.whole.id_to_token(token)
        return name[: len(name) - len(self.suffix)] if self.suffix and name.endswith(self.suffix) else name

    def symbols(self, word: str) -> list[int]:
        """Tokens of a pre-token in the byte alphabet, taken as a whole word."""
        return [t.id for t in self.model.tokenize(word)]

    # Exact joins. Merges go by rank, then place, so a sequence of tokens is the encoding of
    # its bytes if and only if every two neighbours are the encoding of theirs: the first merge
    # across a border would already happen between the two tokens at it. Neighbours inside
    # the left, the right and the window's own encoding are, so both sides only need one token
    # in common with the window. The last token of what was encoded as a word carries the mark
    # of its end and never counts as common, unless the word ends there.

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a word from those of its halves, each encoded as a word."""
        grow = WINDOW
        while True:
            i, j = min(grow, len(left)), min(grow, len(right))
            names = [self.text(t) for t in (*left[len(left) - i:], *right[:j])]
            own = self.symbols("".join(names))
            if i == len(left) and j == len(right):
                return own
            ends = np.cumsum([len(n) for n in names])
            spans = {(int(e) - len(n), int(e), t): k for k, (e, n, t) in enumerate(
                zip(ends, names, (*left[len(left) - i:], *right[:j])))}
            at, met = 0, []
            for k, t in enumerate(own):
                end = at + len(self.text(t))
                if k < len(own) - 1 or j == len(right):
                    met.append((k, spans.get((at, end, t))))
                at = end
            before = (0, len(left) - i) if i == len(left) else next(
                ((k + 1, len(left) - i + s + 1) for k, s in met if s is not None and s < i - 1), None)
            after = (len(own), len(right)) if j == len(right) else next(
                ((k, s - i) for k, s in reversed(met) if s is not None and s >= i), None)
            if before and after:
                return left[: before[1]] + own[before[0]: after[0]] + right[after[1]:]
            grow *= 2

    def tree(self, parts: Sequence[list[int]]) -> list[int]:
        """The encoding of a word from its consecutive pieces', joined pair by pair in a balanced tree."""
        parts = list(parts)
        while len(parts) > 1:
            pairs = [self.join(a, b) for a, b in zip(parts[0::2], parts[1::2])]
            parts = pairs + parts[len(pairs) * 2:]
        return parts[0] if parts else []

    def halves(self, word: str, leaf: int) -> list[str]:
        """Pieces of a word in the byte alphabet, cut in halves until they are short."""
        if len(word) <= leaf:
            return [word]
        middle = len(word) // 2
        return self.halves(word[:middle], leaf) + self.halves(word[middle:], leaf)

    def stretch(self, text: str) -> Iterator[tuple[int | None, str | None]]:
        """A text without blanks as added tokens (id) and pre-tokens in the byte alphabet, in order."""
        at = 0
        for found in [*(self.special.finditer(text) if self.special else ()), None]:
            plain = text[at: found.start() if found else len(text)]
            if plain:
                normal = self.whole.normalizer.normalize_str(plain) if self.whole.normalizer else plain
                for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                    yield None, word
            if found:
                yield self.whole.token_to_id(found.group()), None
                at = found.end()

    def long_word(self, data: bytes) -> list[int]:
        """Tokens of a long stretch without blanks."""
        out: list[int] = []
        for token, word in self.stretch(data.decode()):
            if word is None:
                out.append(token)
            else:
                out += self.tree([self.symbols(p) for p in self.halves(word, LEAF)])
        return out

    def _keep(self, words: list[bytes], tokens: np.ndarray, counts: np.ndarray) -> None:
        """Remember the tokens of new words, which lie one after another."""
        for held, new in (("tokens", tokens.astype(np.int32)), ("counts", counts)):
            have, used = getattr(self, held), self.used[held]
            if used + len(new) > len(have):
                have = np.concatenate([have, np.zeros(len(have) + len(new), have.dtype)])
                setattr(self, held, have)
            have[used: used + len(new)] = new
            if held == "counts":
                if used + len(new) > len(self.begins):
                    self.begins = np.concatenate([self.begins, np.zeros(len(self.begins) + len(new), np.int64)])
                self.begins[used: used + len(new)] = self.used["tokens"] - len(tokens) + np.cumsum(new) - new
                self.place.update(zip(words, range(used, used + len(new))))
            self.used[held] += len(new)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Where the tokens of each of some distinct words are kept; those not seen before are encoded together."""
        if len(self.place) > MEMORY:
            self.forget()
        place = self.place
        fresh = [w for w in words if w not in place]
        short = [w for w in fresh if len(w) <= LEAF]
        for at in range(0, len(short), BLOCK):
            block = short[at: at + BLOCK]
            texts = [w.decode() for w in block]
            # One text of all words, taken apart again by the places of its tokens.
            found = self.whole.encode("\n".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
            owner = np.searchsorted(starts, np.array([o[0] for o in found.offsets], dtype=np.int64), side="right") - 1
            self._keep(block, np.array(found.ids, dtype=np.int32), np.bincount(owner, minlength=len(block)))
        for w in fresh:
            if len(w) > LEAF:
                own = np.array(self.long_word(w), dtype=np.int32)
                self._keep([w], own, np.array([len(own)]))
        return np.array([place[w] for w in words], dtype=np.int64)

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.tokens, self.counts, self.begins = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = {"tokens": 0, "counts": 0}

    def texts(self, texts: pa.Array) -> pa.Array:
        """Tokens of whole texts: those of their words, one after another. A null text has none."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        at = self.words(distinct)[words.indices.to_numpy()]
        counts = self.counts[at]
        ends = np.cumsum(counts)
        flat = self.tokens[np.repeat(self.begins[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def tokenizer_config(path: str) -> str:
    """The vocabulary file's text; it is read by the driver and travels with the jobs."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def cut_text(encoder: Encoder, data: bytes, piece: int) -> Iterator[tuple[bytes | None, list[str] | None, list[int] | None, bool]]:
    """A long text as (text, pre-tokens, tokens, joined) pieces in order.

    Cuts fall on blanks where there are some. A longer stretch without blanks is taken apart
    into added tokens and pre-tokens; a long pre-token is cut in halves, each a piece of
    its own, and ``joined`` says that a piece goes on with the word of the piece before.
    """
    at = 0
    while at < len(data):
        if len(data) - at <= piece:
            yield data[at:], None, None, False
            return
        cut = max(data.rfind(bytes([b]), at + 1, at + piece) for b in BLANKS)
        if cut > at:
            yield data[at:cut], None, None, False
            at = cut
            continue
        blank = BLANK.search(data, at + 1)
        end = blank.start() if blank else len(data)
        held, size = [], 0
        for token, word in encoder.stretch(data[at:end].strip(BLANKS).decode()):
            parts = encoder.halves(word, piece) if word is not None else []
            if held and (len(parts) != 1 or size + len(parts[0]) > piece):
                yield None, held, None, False
                held, size = [], 0
            if word is None:
                yield None, None, [token], False
            elif len(parts) > 1:
                for k, p in enumerate(parts):
                    yield None, [p], None, k > 0
            else:
                held.append(word)
                size += len(word)
        if held:
            yield None, held, None, False
        at = end


def encode_texts(docs: DataFrame, config: str, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(key, ids): the tokens of every whole text, as the library encodes it without special tokens around it.

    Null and empty texts have no tokens. Repeated rows each have a result; other columns are
    not read. Texts above ``piece`` bytes are counted by (key, text), cut, dealt out to tasks
    and put together again, pieces of one word by tree concatenation. One text's tokens are one row.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    named = StructField("ids", StructType.fromDDL("ids array<int>")["ids"].dataType)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        encoder = Encoder(config)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part, [encoder.texts(part.column("text"))]

    short = map_columns(rows.filter(F.octet_length("text") <= piece), "text", "ids array<int>", encode, keep=False)
    long = rows.filter(F.octet_length("text") > piece).groupBy("key", "text").agg(F.count(F.lit(1)).alias("times"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(config)
        for batch in batches:
            for part in slices(batch, "text"):
                for i in range(len(part)):
                    data = part.column("text")[i].as_py().encode()
                    digest = hashlib.sha256(data).digest()
                    for place, (plain, words, ids, joined) in enumerate(cut_text(encoder, data, piece)):
                        yield pa.RecordBatch.from_arrays([
                            part.column("key")[i: i + 1], part.column("times")[i: i + 1], pa.array([digest], pa.binary()),
                            pa.array([place], pa.int64()), pa.array([joined]), pa.array([plain], pa.binary()),
                            pa.array([words], pa.list_(pa.string())), pa.array([ids], pa.list_(pa.int32()))], names=pieces.names)

    own = StructField("key", rows.schema["key"].dataType)
    place = StructType.fromDDL("times long, digest binary, place long, joined boolean")
    pieces = StructType([own, *place.fields, *StructType.fromDDL("plain binary, words array<string>").fields, named])
    dealt = long.mapInArrow(cut, pieces).repartition("key", "digest", "place")

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(config)
        for batch in batches:
            out = []
            for plain, words, ids in zip(*[batch.column(c).to_pylist() for c in ("plain", "words", "ids")]):
                if plain is not None:
                    out.append(encoder.texts(pa.array([plain.decode()])).values.to_numpy())
                elif words is not None:
                    found = [t for w in words for t in encoder.tree([encoder.symbols(p) for p in encoder.halves(w, LEAF)])]
                    out.append(np.array(found, dtype=np.int32))
                else:
                    out.append(np.array(ids, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], _lists(out)], names=encoded.names)

    encoded = StructType([own, *place.fields, named])
    parts = dealt.mapInArrow(encode_pieces, encoded).groupBy("key", "digest").agg(
        F.first("times").alias("times"), F.sort_array(F.collect_list(F.struct("place", "joined", "ids"))).alias("parts"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(config)
        for batch in batches:
            for i in range(len(batch)):
                runs: list[list[list[int]]] = []
                for p in batch.column("parts")[i].as_py():
                    if p["joined"]:
                        runs[-1].append(p["ids"])
                    else:
                        runs.append([p["ids"]])
                whole = np.array([t for run in runs for t in encoder.tree(run)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key")[i: i + 1], batch.column("times")[i: i + 1], _lists([whole])], names=["key", "times", "ids"])

    whole = parts.select("key", "times", "parts").mapInArrow(put_together, StructType([own, place["times"], named]))
    return short.unionByName(repeat_rows(whole, "times")).withColumnRenamed("key", key)


def _lists(values: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def decode_ids(encoded: DataFrame, config: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library decodes from its tokens, special ones included.

    Null tokens decode to null. Other columns may have any names; one named like the result is
    replaced.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        whole = Encoder(config).whole
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                column = part.column("text")
                sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
                flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                texts = [
                    whole.decode(flat[e - n: e].tolist(), skip_special_tokens=False) if ok else None
                    for e, n, ok in zip(ends.tolist(), sizes.tolist(), column.is_valid().to_pylist())]
                yield part, [pa.array(texts, pa.string())]

    return map_columns(encoded, ids, f"`{out}` string", decode)
