"""Token counts of texts for a piece tokenizer, most of them by looking words up instead of merging them.

A pair encoder only ever joins neighbours into a piece of its vocabulary. If no piece holds a space after another character, no
merge crosses the start of a word, so a text's count is the sum over its words. The vocabulary's own strings are encoded once, on the driver; those that
come out as one token are proven to cost one, and every other word is merged once and then remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from telltale.llm.rows import small, texts

SPACE = "▁"  # how the vocabulary writes a space
REMEMBERED = 200_000
LONGEST_REMEMBERED = 48
SLICE = 1 << 20
WORD = re.compile(" +[^ ]*")


@dataclass
class WholeTokens:
    """The tokenizer's file, and the words (without their leading space) that are proven to be one token each."""

    model: bytes
    words: frozenset[str]


def prove(path: str) -> WholeTokens:
    """Read a ``.model`` file and encode each string of its vocabulary that can be a whole word.

    Both facts that the counts rest on are checked here, whatever the file: that no piece holds a space after another character, and that the
    tokenizer only marks spaces and changes nothing else. Another kind of file is refused.
    """
    if not path.endswith(".model"):
        raise ValueError(f"Token counts need a .model file, not {path}.")
    with open(path, "rb") as file:
        model = file.read()
    encoder = SentencePieceProcessor(model_proto=model)
    pieces = [encoder.id_to_piece(i) for i in range(encoder.vocab_size()) if not (encoder.is_control(i) or encoder.is_unknown(i) or encoder.is_byte(i))]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("A piece holds a space after another character, so words can't be counted one by one.")
    sample = "  AＡéé \tﬁ \n​  x "
    if encoder.normalize(sample) != SPACE + sample.replace(" ", SPACE) or encoder.encode("\n", out_type=str)[0] != SPACE:
        raise ValueError("The tokenizer changes texts before it encodes them.")
    words = [p[1:] for p in pieces if len(p) > 1 and p[0] == SPACE and p[1] != SPACE]
    alone = encoder.encode(words, num_threads=1)
    return WholeTokens(model, frozenset(w for w, ids in zip(words, alone, strict=True) if len(ids) == 1))


class Counter(dict):
    """Tokens of a word that follows one space. Looks up proven words, merges the others, and remembers a bounded number of those."""

    def __init__(self, known: WholeTokens):
        super().__init__(dict.fromkeys(known.words, 1))
        self[""] = 1  # a space alone
        self.known, self.most = known, len(known.words) + REMEMBERED
        self.encoder = SentencePieceProcessor(model_proto=known.model)

    def __missing__(self, word: str) -> int:
        tokens = len(self.encoder.encode(word))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.known.words, 1))
                self[""] = 1
            self[word] = tokens
        return tokens

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(sum(map(self.__getitem__, words)) for words in words_of(text.replace(SPACE, " ")))


def words_of(text: str) -> Iterator[list[str]]:
    """A text's words without the one space before each, in lists of bounded size. Further spaces stay with the word that they precede."""
    start = 0
    while start <= len(text):
        end = start + SLICE
        while 0 < end < len(text) and not (text[end] == " " and text[end - 1] != " "):
            # The next place where a word ends; a run of spaces belongs to the word behind it.
            end = text.find(" ", end + 1) if text[end] != " " else end + 1
        part = text[start:end] if 0 < end < len(text) else text[start:]
        if "  " in part or part.startswith(" ") or part.endswith(" "):
            yield [w[1:] for w in WORD.findall(" " + part)]
        else:
            yield part.split(" ")
        start += len(part) + 1


def count_tokens(docs: DataFrame, known: WholeTokens, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row: its text's bytes in UTF-8, its tokens, and whether these are more than ``limit``.

    Counts are those of the tokenizer without begin and end tokens; strings that look like special tokens are ordinary text, as is its default. Null and empty
    texts have no bytes and no tokens. Bytes that are no UTF-8 count as the replacement character in tokens. Repeated rows and ids are counted each; other
    columns are not read, so none can clash. An empty table gives no rows.
    """
    source = texts(docs, id_col, text_col)
    fields = T.StructType(
        [source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def run(batches):
        counter = Counter(known)
        for batch in small(batches):
            sizes, tokens = [], []
            for value in batch.column(1):
                blob = value.as_py() or b""
                sizes.append(len(blob))
                tokens.append(counter.count(blob.decode("utf-8", "replace")))
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())], names=fields.names)

    return source.mapInArrow(run, fields)


def unknown_share(docs: DataFrame, known: WholeTokens, text_col: str = "text") -> DataFrame:
    """One row, ``words, whole``: the words of all texts, and those that are counted without merging."""
    source = docs.select(F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        words = whole = 0
        for batch in small(batches):
            for value in batch.column(0):
                text = (value.as_py() or b"").decode("utf-8", "replace")
                for part in words_of(text.replace(SPACE, " ")) if text else ():
                    words += len(part)
                    whole += sum(map(known.words.__contains__, part))
        yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([whole])], names=["words", "whole"])

    return source.mapInArrow(run, "words long, whole long").agg(F.sum("words").alias("words"), F.sum("whole").alias("whole"))
