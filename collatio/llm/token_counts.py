"""Token counts by overlap resynchronisation.

A text of up to CHUNK characters is encoded whole. A longer one is encoded in chunks that overlap, each with the
offsets of its pre-tokens. Two neighbouring chunks are spliced where both have a pre-token boundary at the same place.

Why such a boundary is proven: the splitter is one left-to-right scan without look-behind, so what follows a boundary
depends on the text behind it alone. Two scans that meet at one boundary stay together for good. A scan of a cut
text equals the scan of the whole text up to MARGIN characters before the cut: a split that ends there has seen all the
characters that its longest alternative, its look-ahead and the longest special string could need. When an overlap
holds no common boundary (one pre-token covers it), the overlap is doubled and the chunk is encoded again, until they
meet or the chunk reaches the end of the text.

Plain text takes the same vocabulary's ranks in the faster library, with equal results; texts with special strings or
with characters outside PLAIN, whose classes depend on a library's Unicode version, take the vocabulary's own library.

Nulls count as empty texts: 0 bytes, 0 tokens. Repeated rows give repeated rows. Empty tables give empty tables. Other
columns stay as they are; the result is one struct column whose name the caller chooses, and a column of that
name is replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import bound_batches

#: Characters of a chunk, and of its first overlap with the next.
CHUNK, OVERLAP = 65_536, 512
#: Characters whose class is the same in all versions of both libraries.
PLAIN = re.compile("[\t\n\r -~\xa1-ɏΑ-ΡΣ-ώА-я‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]*")
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"


def default_vocabulary() -> str:
    """The address of the vocabulary file that queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """Counts tokens of texts with a byte-level vocabulary file of the tokenizers library, and ranks of the same if given."""

    def __init__(self, vocabulary: str, ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.tok = Tokenizer.from_file(vocabulary)
        self.tok.no_truncation()
        self.tok.no_padding()
        if self.tok.normalizer is not None:
            raise ValueError("a vocabulary with a normaliser has no stable offsets")
        self.tok.post_processor = processors.ByteLevel(trim_offsets=False)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.margin = 4 + max(map(len, self.special), default=0)
        self.chunk, self.overlap = max(chunk, 2 * self.margin), max(overlap, 2 * self.margin)
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def whole(self, texts: list[str]) -> list[int]:
        """Tokens of each text, encoded in one piece."""
        out, slow = [0] * len(texts), []
        for i, t in enumerate(texts):
            if self.fast and PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                out[i] = len(self.fast.encode_ordinary(t))
            else:
                slow.append(i)
        for i, e in zip(slow, self.tok.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out

    def bounds(self, text: str, start: int, end: int) -> dict[int, int]:
        """Each pre-token boundary of text[start:end], as a place in text, and the tokens before it."""
        e = self.tok.encode(text[start:end], add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        out = {start: 0}
        for i in range(1, len(words)):
            if words[i] != words[i - 1]:
                out[start + offsets[i][0]] = i
        out[end] = len(words)
        return out

    def long(self, text: str) -> tuple[int, int, int]:
        """(tokens, chunks, widenings) of a text, by chunks. `here` is always a proven boundary, and `left` counts from it."""
        n, total, chunks, widened = len(text), 0, 1, 0
        here, end = 0, min(self.chunk, n)
        left = self.bounds(text, here, end)
        while end < n:
            overlap, meet = self.overlap, []
            while not meet and end < n:
                start = end - overlap
                if start <= here:  # no common boundary in all of the left chunk: it becomes twice as long
                    end, overlap, widened = min(n, here + 2 * (end - here)), self.overlap, widened + 1
                    left = self.bounds(text, here, end)
                    continue
                stop = min(n, max(start + self.chunk, end + self.chunk // 2))
                right = self.bounds(text, start, stop)
                meet = [p for p in right.keys() & left.keys() if here < p <= end - self.margin]
                overlap, widened = 2 * overlap, widened + (not meet)
            if meet:
                p = max(meet)
                total += left[p]
                left = {q: k - right[p] for q, k in right.items() if q >= p}
                here, end, chunks = p, stop, chunks + 1
        return total + left[n], chunks, widened

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [(0, 1, 0)] * len(texts)
        for i, k in zip(short, self.whole([texts[i] for i in short]), strict=True):
            out[i] = (k, 1, 0)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.long(t)
        return out


def token_counts(text: Column | str, vocabulary: str | None = None, ranks: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Struct column: n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks, n_widened of a text column.

    ranks: the same vocabulary as a rank file, or None to use the vocabulary's own library for every text.
    """
    vocabulary = vocabulary or default_vocabulary()

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary, ranks, chunk, overlap)
        for texts in batches:
            texts = [t or "" for t in texts]
            found = counter.count(texts)
            yield pd.DataFrame({"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [x[0] for x in found], "over_limit": [x[0] > limit for x in found], "n_chunks": [x[1] for x in found], "n_widened": [x[2] for x in found]})

    return run.asNondeterministic()(text)


def with_token_counts(df: DataFrame, text: str = "text", into: str = "tokens", **options) -> DataFrame:
    """df and a struct column of token_counts."""
    bound_batches(df.sparkSession)
    return df.withColumn(into, token_counts(df[text], **options))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, by the production vocabulary."""
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    out = with_token_counts(docs, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "tokens.*")
