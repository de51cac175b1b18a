"""Quality classifier by compression: dictionaries of good and of bad labelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

#: Labelled rows of each kind that are learned from, and their characters, at most; half train dictionaries, half calibrate.
SAMPLE, CHARACTERS = 4000, 16_000_000
#: Bytes of a dictionary; bytes of the parts that are compressed apart; level.
DICTIONARY, PART, LEVEL = 1 << 16, 300, 3
THRESHOLD, MODULUS, REMAINDER = 0.3, 5, 0


class Compressors:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.both = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x), level=LEVEL, write_content_size=False) for x in (good, bad)]

    def differences(self, text: str | None) -> tuple[float, float, float]:
        """(bad - good) / (bad + good) over the whole text; the same for its worst part; its most compressible part's ratio."""
        data = (text or "").encode("utf-8", "surrogatepass")
        parts = [data[at : at + PART] for at in range(0, len(data), PART)]
        if len(parts) > 1 and len(parts[-1]) < PART // 2:
            parts[-2:] = [parts[-2] + parts[-1]]
        if not parts:
            return 0.0, 0.0, 1.0
        good, bad = ([len(c.compress(x)) for x in parts] for c in self.both)
        worst = min((b - g) / (b + g) for g, b in zip(good, bad, strict=True))
        return (sum(bad) - sum(good)) / (sum(bad) + sum(good)), worst, min(min(g, b) / len(x) for g, b, x in zip(good, bad, parts, strict=True))


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    import zstandard

    parts = [data[at : at + PART] for data in (x.encode("utf-8", "surrogatepass") for x in texts) for at in range(0, len(data), PART)]
    total = sum(map(len, parts))
    if total < 4096:
        return b"".join(parts) or b"\0" * 8
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS):
    """(good, bad, slopes, shift) from at most `sample` labelled rows of each kind and about `characters` characters of each (see `labelled.sample`)."""
    texts = labelled.sample(docs, labels, "quality", MODULUS, REMAINDER, sample, characters)
    good, bad = dictionary(texts[1][::2]), dictionary(texts[0][::2])
    both = Compressors(good, bad)
    rest = [(both.differences(x), y) for y in (0, 1) for x in texts[y][1::2]]
    return good, bad, *labelled.logistic_fit([x for x, _ in rest], [y for _, y in rest], 3)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """A row (doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels (doc_id, quality) teach.

    score is the calibrated difference of compressed sizes under both dictionaries (of the whole text and of its worst part, with the
    ratio of its most compressible part), near 1 for good text. Null and
    empty texts score as a difference of 0 and a ratio of 1. Rows without doc_id are scored, not held out. Without labels of both kinds the score is the share of the labels.
    Repeated rows score alike; an empty table gives no rows. Nothing is shuffled but the labelled rows.
    """
    docs = common.documents(docs)
    good, bad, slopes, shift = fit(docs, labels, sample)

    def score(batches):
        import pyarrow as pa

        both = Compressors(good, bad)
        for batch in batches:
            value = labelled.logistic(slopes, shift, [both.differences(x) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(value), pa.array((value >= threshold).astype("i4"))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.withColumn("held_out", labelled.held_out(MODULUS, REMAINDER)).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
