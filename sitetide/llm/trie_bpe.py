"""Byte-pair encoding by prefixes: the distinct words of a batch form a trie, and each shared prefix is encoded once.

The encoding of a prefix is known from its last token: that is the one token that ends the prefix and may stand after the
last token of what precedes it. A depth-first walk over the trie hands these last tokens from parent to child; an encoding
is then read backwards along its path.

The configuration is a ``tokenizers`` JSON file: byte-level BPE with an end-of-word suffix, added tokens that are cut out of
the raw text, a Split pattern, no post-processor, no decoder (decoding joins the tokens with spaces).
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitetide.llm.common import batch_slices, handing_back
from sitetide.session import ship_package

#: Fixed value: the white space of the Unicode standard, which the configuration's patterns mean by \s.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Words whose encodings a worker remembers; the oldest half is forgotten beyond that.
REMEMBERED = 200_000
#: Bytes of text that are handled at once.
SLICE = 1 << 20
NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """The visible characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_names(setup: dict) -> dict[int, str]:
    return {i: t for t, i in setup["model"]["vocab"].items()} | {t["id"]: t["content"] for t in setup["added_tokens"]}


def decode(names: dict[int, str], ids: np.ndarray) -> str:
    """Tokens joined by spaces; ids outside the vocabulary are left out."""
    return " ".join([t for t in map(names.get, ids.tolist()) if t is not None])


class Encoder:
    """Tokens, their compatible neighbours and the walk. Symbols are bytes as characters 0 to 255, 256 more at a word's end."""

    def __init__(self, config: str) -> None:
        self.config = config
        setup = json.loads(config)
        model = setup["model"]
        suffix = model["end_of_word_suffix"]
        split = next(p for p in setup["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if model["type"] != "BPE" or setup["decoder"] or setup["post_processor"] or not split["invert"]:
            raise ValueError("only byte-level BPE with a word pattern, without decoder or post-processor")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in setup["added_tokens"]):
            raise ValueError("added tokens must be matched in the raw text as they are")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE)).findall
        self.added = {t["content"]: t["id"] for t in setup["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.names = token_names(setup)
        self._normalize: Callable[[str], str] | None = None

        codes = byte_characters()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            plain = [codes[c] for c in (token[:-len(suffix)] if ends else token)]
            return "".join(map(chr, plain[:-1])) + chr(plain[-1] + 256 * ends)

        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.span = max(self.names) + 1
        self.rank = {vocab[a] * self.span + vocab[b]: i for i, (a, b) in enumerate(merges)}
        parts = {vocab[a + b]: (vocab[a], vocab[b], i) for i, (a, b) in enumerate(merges)}
        # A token's two parts, the rank of the merge that makes it and its length, by id; plain numbers, as every worker holds them.
        self.first, self.second, self.made, self.size = (array("i", [fill]) * self.span for fill in (-1, -1, -1, 0))
        self.tokens: dict[str, int] = {}
        for token in sorted(vocab, key=lambda t: parts.get(vocab[t], (0, 0, -1))[2]):
            i = vocab[token]
            if all(c in codes for c in token.removesuffix(suffix)) and token != suffix:
                made, form = parts.get(i), symbols(token)
                if made:
                    a, b, rank = made
                    if not self.size[a] or not self.size[b] or not self._joins(a, b, rank):
                        continue  # no encoding has it
                    self.first[i], self.second[i], self.made[i] = made
                elif len(form) > 1:
                    continue
                self.size[i] = len(form)
                self.tokens[form] = i
        self.beginnings = {form[:n] for form in self.tokens for n in range(1, len(form) + 1)}
        self._forms, self._states, self._steps, self._found = [""], {"": 0}, [{}], [[]]
        self._pairs: dict[int, bool] = {}
        self._alone = {i: array("i", [i]).tobytes() for i in self.added.values()}
        self._young: dict = dict(self._alone)
        self._old: dict = {}

    def _joins(self, a: int, b: int, rank: int) -> bool:
        """Whether a and b side by side are built and then merged by the merge of this rank, and nothing crosses before."""
        return not self._crossed(self._edge(a, self.second, rank), self._edge(b, self.first, rank), a * self.span + b)

    def _edge(self, token: int, side: array, ends: int = NEVER) -> list[tuple[int, int]]:
        """What stands at a token's right (side: second) or left edge (first) while it is built, and the rank of the merge that ends it."""
        out = [(token, ends)]
        while side[token] >= 0:
            ends, token = self.made[token], side[token]
            out.append((token, ends))
        return out

    def _crossed(self, right: list, left: list, but: int | None = None) -> bool:
        # Of equal merges the one further left comes first: the one inside the left token, then the crossing one.
        for a, a_ends in right:
            for b, b_ends in left:
                r = self.rank.get(a * self.span + b)
                if r is not None and r < a_ends and r <= b_ends and a * self.span + b != but:
                    return True
        return False

    def _follows(self, a: int, b: int) -> bool:
        key = a * self.span + b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = not self._crossed(self._edge(a, self.second), self._edge(b, self.first))
        return known

    def _step(self, state: int, symbol: str) -> int:
        """The state after one more symbol. A state is the longest end of a prefix with which a token begins."""
        form = self._forms[state] + symbol
        while form and form not in self.beginnings:
            form = form[1:]
        to = self._states.get(form)
        if to is None:
            to = self._states[form] = len(self._forms)
            self._forms.append(form)
            self._steps.append({})
            ends = (form[i:] for i in range(len(form)))
            self._found.append([(self.tokens[e], len(e)) for e in ends if e in self.tokens])
        self._steps[state][symbol] = to
        return to

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Token ids of distinct words, four bytes each. Sorted, they are the leaves of their trie in depth-first order; the stacks hold the
        last tokens and states of all prefixes of the current word, and a word keeps those it shares with the one before."""
        forms = []
        for word in words:
            b = word.encode()
            forms.append((b[:-1].decode("latin-1") + chr(b[-1] + 256), word))
        forms.sort()
        out, before, last, path = {}, "", [-1], [0]
        steps, found, size, pairs, follows, span = self._steps, self._found, self.size, self._pairs, self._follows, self.span
        for form, word in forms:
            shared = 0
            for x, y in zip(form, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], path[shared + 1:]
            state, at = path[-1], shared
            for symbol in form[shared:]:
                at += 1
                to = steps[state].get(symbol)
                state = self._step(state, symbol) if to is None else to
                for token, length in found[state]:
                    prior = last[at - length]
                    if prior < 0:
                        break
                    known = pairs.get(prior * span + token)
                    if known if known is not None else follows(prior, token):
                        break
                else:
                    raise ValueError(f"a symbol of {word!r} is not in the vocabulary")
                last.append(token)
                path.append(state)
            ids, at = [], len(form)
            while at:
                token = last[at]
                ids.append(token)
                at -= size[token]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
            before = form
        return out

    def normalize(self, text: str) -> str:
        """NFC and lower case; white space may stay, as no word holds any. Rarer cases go through the tokenizer library's own rules."""
        if unicodedata.is_normalized("NFC", text) and "Σ" not in text:
            return text.lower()
        if self._normalize is None:
            from tokenizers import Tokenizer

            self._normalize = Tokenizer.from_str(self.config).normalizer.normalize_str
        return self._normalize(text)

    def pieces(self, text: str) -> list:
        """Words of a text in order; added tokens as their ids."""
        if self.cut is None or not any(t in text for t in self.added):
            return self.words(self.normalize(text))
        out: list = []
        for part in self.cut(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.words(self.normalize(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of all texts, and where each text's ids start."""
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        codes, counts = [], [0]
        for text in texts:
            codes += map(index.__getitem__, self.pieces(text))
            counts.append(len(codes))
        young, old = self._young, self._old
        young |= {w: old[w] for w in index if w in old}
        young |= self.encode_words([w for w in index if w not in young])
        known = [young[w] for w in index]
        if len(young) > REMEMBERED // 2:
            self._old, self._young = young, dict(self._alone)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.int32)
        first = np.cumsum(lengths) - lengths
        code = np.asarray(codes, dtype=np.int64)
        each = lengths[code]
        starts = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(first[code] - starts[:-1], each) + np.arange(starts[-1])]
        return ids, starts[np.asarray(counts)]

    def decode(self, ids: np.ndarray) -> str:
        return decode(self.names, ids)

    def forget(self) -> None:
        """Free what was remembered: a worker process outlives the task."""
        self._pairs.clear()
        self._young, self._old = dict(self._alone), {}


_ENCODERS: dict[int, Encoder] = {}


def encoder(config: str) -> Encoder:
    """One encoder per worker process and configuration."""
    key = hash(config)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(config)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns of ``docs`` and ``ids``, the token ids of the whole text. ``tokenizer``: path of the configuration on the driver.
    With ``decoded``, a column of that name has what the ids decode to, as decode_documents makes it, by the same workers.

    Null and empty texts have no ids; repeated rows and nulls elsewhere pass through; a column named like ``ids`` is replaced;
    an empty table stays empty. Narrow: no shuffle. The configuration (some MB) is broadcast; a worker's memory is bounded by
    a slice of texts, one longest text and the remembered words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop(ids, *[decoded] * (decoded is not None))
    config = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    added += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(config.value)
        yield from coded(coder, batches, text, schema.names, decoded is not None)
        coder.forget()

    return docs.mapInArrow(handing_back(run), schema)


def coded(coder: Encoder, batches: Iterator[pa.RecordBatch], text: str, names: list[str], with_decoded: bool) -> Iterator[pa.RecordBatch]:
    """The rows of the batches with their ids and, if asked for, what these decode to. Only a slice's texts are Python strings at once."""
    for batch in batches:
        texts = batch.column(text)
        starts = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        for a, b in batch_slices(starts, SLICE):
            flat, at = coder.encode([x or "" for x in texts.slice(a, b - a).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            part = batch.slice(a, b - a)
            more = [pa.array([coder.decode(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.string())] if with_decoded else []
            yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], names)


def decode_documents(encoded: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of the ids; null or empty lists give an empty text."""
    spark = encoded.sparkSession
    ship_package(spark)
    encoded = encoded.drop(decoded)
    config = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    schema = T.StructType([*encoded.schema.fields, T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(json.loads(config.value))
        for batch in batches:
            starts = np.concatenate([[0], np.cumsum(batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            for a, b in batch_slices(starts, SLICE // 4):
                part = batch.slice(a, b - a)
                lists = part.column(ids)
                texts = [decode(names, lists[i].values.to_numpy()) if lists[i].is_valid else "" for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, decoded])

    return encoded.mapInArrow(handing_back(run), schema)
