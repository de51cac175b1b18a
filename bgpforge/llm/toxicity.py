"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled passages.

The kernel of two words is the gap-weighted subsequence kernel of order 3 over their letters and a sign for the word's start: every
common subsequence of three counts DECAY to the power of the places it spans in both words. It is divided by the root of each word's kernel
with itself and raised to POWER, which is a kernel again and a sharper one. Signs between letters are only gaps, so gapped, starred and
inserted-character spellings stay near the word itself. The kernel of two passages (whole sentences, up to PASSAGE words) is the mean kernel of
their words. Landmark words, drawn from the labelled passages of both kinds in every language alike, map a passage to Nystroem features, on which
a linear machine with squared hinge loss learns the labels of the passages' texts.

The machine's value of a passage is then the mean of values of its words. A text scores by its words' values as a whole, by how much
of it lies above the values that words of clean texts have, and by its worst passage; a logistic curve, fitted on texts the machine was not trained on,
makes a probability of the three.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

ORDER, DECAY, POWER = 3, 0.7, 4
#: Places that a subsequence spans at most: longer ones weigh next to nothing.
SPAN = 6
#: Characters of a word that are compared at once; longer ones go in overlapping parts.
LONG, OVERLAP = 24, 12
#: Words of a passage.
PASSAGE = 128
LANDMARKS = 128
#: Kernels below it, before they are raised to POWER, count as 0.
FLOOR = 0.35
#: Buckets that subsequences are hashed to, as a power of two.
BITS = 18
#: Bounds of the sample that is learned from: labelled texts of each kind, and their characters.
TEXTS, CHARACTERS = 2500, 2_500_000
THRESHOLD, MODULUS, REMAINDER = 0.7, 3, 1
_EDGE = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~"
_END = (".", "!", "?")


def units(raw: list[str]) -> list[str]:
    """The lower-cased words without signs at their ends; runs of three single letters or more are joined to one word as well.

    A word of more than LONG characters goes in parts of LONG, each OVERLAP after the one before.
    """
    out: list[str] = []
    run: list[str] = []
    for w in raw:
        w = w.strip(_EDGE)
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out += _parts("".join(run))
        run = []
        if w:
            out += [w] if len(w) <= LONG else _parts(w)
    return out + _parts("".join(run)) if len(run) > 2 else out


def _parts(w: str) -> list[str]:
    return [w[at : at + LONG] for at in range(0, max(1, len(w) - OVERLAP), LONG - OVERLAP)]


def passages(text: str | None):
    """The units of each passage of a text: whole sentences up to PASSAGE words, cut within a sentence only beyond twice that."""
    held: list[str] = []
    for w in (text or "").lower().split():
        held.append(w)
        if len(held) >= 2 * PASSAGE or len(held) >= PASSAGE and w.endswith(_END):
            yield units(held)
            held = []
    if held:
        yield units(held)


class Kernel:
    """Gap-weighted subsequences of words, hashed."""

    #: Subsequences of one step: bounds its memory.
    STEP = 50_000

    def __init__(self):
        import numpy as np

        self.odd = np.random.default_rng(3).integers(1, 2**62, ORDER, dtype="u8") | np.uint64(1)
        self.shapes: dict = {}

    def _shape(self, size: int):
        """The places of all subsequences of a word of this size, and their weights, of unit length together."""
        from itertools import combinations

        import numpy as np

        if size not in self.shapes:
            places = np.array([x for x in combinations(range(size), ORDER) if x[-1] - x[0] < SPAN], "i8").reshape(-1, ORDER).T
            weight = DECAY ** (places[-1] - places[0] + 1.0)
            self.shapes[size] = places, (weight / np.sqrt((weight * weight).sum())).astype("f4")
        return self.shapes[size]

    def groups(self, words: list[str]):
        """(positions, buckets, weights) of words of one size at a time, a row for each word.

        Subsequences with a sign that is neither letter nor digit weigh 0; the others of a row have unit length together if no two are equal,
        and a greater one if some are (see `length`). Words without any subsequence are left out.
        """
        import numpy as np

        sizes = np.fromiter(map(len, words), "i8", len(words))
        for size in np.unique(sizes):
            places, weight = self._shape(int(size) + 1)
            if not len(weight):
                continue
            at = np.nonzero(sizes == size)[0]
            step = max(1, self.STEP // len(weight))
            for first in range(0, len(at), step):
                some = at[first : first + step]
                points = np.array(["\n" + words[i] for i in some], f"<U{size + 1}").view("u4").reshape(len(some), size + 1)
                key = np.zeros((len(some), len(weight)), "u8")
                for odd, row in zip(self.odd, places, strict=True):
                    key ^= points[:, row]
                    key *= odd
                    key ^= key >> np.uint64(29)
                key >>= np.uint64(64 - BITS)
                gap = np.array([not words[i].isalnum() for i in some])
                value = np.broadcast_to(weight, key.shape)
                if gap.any():
                    value = value.copy()
                    for i in np.flatnonzero(gap):
                        solid = np.array([True, *map(str.isalnum, words[some[i]])])
                        value[i] *= solid[places].all(axis=0)
                        value[i] /= max(float(np.sqrt((value[i] * value[i]).sum())), 1e-9)
                yield some, key.astype("i4"), value

    @staticmethod
    def length(key, value):
        """The length of each row, where weights of the same bucket add up."""
        import numpy as np

        order = np.argsort(key, axis=1, kind="stable")
        sorted_key, sorted_value = np.take_along_axis(key, order, 1), np.take_along_axis(value, order, 1)
        new = np.ones(key.shape, bool)
        new[:, 1:] = sorted_key[:, 1:] != sorted_key[:, :-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(sorted_value.ravel(), first)
        length = np.sqrt(np.bincount(first // key.shape[1], total * total, len(key)))
        return np.where(length > 0, length, 1.0)


class Landmarks:
    """Kernels of words with landmark words, by the subsequences that the landmarks hold."""

    def __init__(self, words: list[str]):
        import numpy as np

        self.kernel, self.n = Kernel(), len(words)
        found = [(key.ravel(), np.repeat(at, key.shape[1]), (value / Kernel.length(key, value)[:, None]).ravel()) for at, key, value in self.kernel.groups(words)] or [(np.zeros(0, "i4"), np.zeros(0, "i8"), np.zeros(0))]
        key, of, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[order], np.arange((1 << BITS) + 1)).astype("i4")
        self.of, self.value = of[order].astype("i4"), value[order].astype("f4")

    def kernels(self, words: list[str]):
        """A row for each word: its kernel with each landmark. What is below FLOOR before it is raised to POWER counts as 0."""
        import numpy as np

        out = np.zeros((len(words), self.n), "f4")
        for at, key, value in self.kernel.groups(words):
            many = self.first[key + 1] - self.first[key]
            row, column = np.nonzero(many)
            if not len(row):
                continue
            start, many = self.first[key[row, column]], many[row, column]
            ends = np.cumsum(many, dtype="i4")
            place = np.arange(ends[-1], dtype="i4") - np.repeat(ends - many - start, many)
            cell = np.repeat((row * self.n).astype("i4"), many) + self.of[place]
            found = np.bincount(cell, np.repeat(value[row, column], many) * self.value[place], len(at) * self.n).reshape(len(at), self.n)
            # Without regard to equal subsequences a kernel is too large, if anything.
            near = np.flatnonzero(found.max(axis=1) >= FLOOR)
            found = found[near] / Kernel.length(key[near], value[near])[:, None] if len(near) else found[near]
            out[at[near]] = np.where(found >= FLOOR, found, 0.0) ** POWER
        return out


def squared_hinge(x, y, cost, decay: float = 1.0):
    """Weights of a linear machine (the last one is its shift): squared hinge loss, by Newton steps."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    sign, w = np.where(y > 0, 1.0, -1.0), np.zeros(x.shape[1])
    for _ in range(40):
        inside = sign * (x @ w) < 1
        some, c = x[inside], cost[inside]
        new = np.linalg.solve(some.T @ (some * c[:, None]) + decay * np.eye(len(w)), some.T @ (c * sign[inside]))
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


class Machine:
    """Values of words, and the three values of a text. Remembers words it has valued, a bounded number."""

    REMEMBERED, STEP = 100_000, 2_000
    #: Words of texts that are valued in one go.
    BATCH = 50_000

    def __init__(self, marks: list[str], weights, noise: float):
        self.marks, self.weights, self.noise, self.known = marks, weights, noise, {}
        self.landmarks = Landmarks(marks)

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.REMEMBERED:
            self.known.clear()
            new = list(words)
        for at in range(0, len(new), self.STEP):
            some = new[at : at + self.STEP]
            self.known.update(zip(some, (self.landmarks.kernels(some) @ self.weights / self.noise).tolist(), strict=True))

    def values(self, texts) -> list[tuple[float, float, float]]:
        """For each text: the mean value of its words, the mean of what exceeds the noise, the largest such mean of a passage.

        What exceeds is counted from twice the noise on, up to six times it, in units of it. All three are 0 for a text without words.
        """
        import numpy as np

        sums: list[list] = []  # sum, excess, words, worst of each text
        held: list[tuple] = []
        size = 0

        def flush():
            self.learn({w for _, words in held for w in words})
            for i, words in held:
                value = np.fromiter(map(self.known.__getitem__, words), "f8", len(words))
                excess = float(np.clip(value - 2, 0, 6).sum())
                now = sums[i]
                sums[i] = [now[0] + float(value.sum()), now[1] + excess, now[2] + len(words), max(now[3], excess / max(len(words), PASSAGE // 4))]
            held.clear()

        for i, text in enumerate(texts):
            sums.append([0.0, 0.0, 0, 0.0])
            for words in passages(text):
                if words:
                    held.append((i, words))
                    size += len(words)
                    if size >= self.BATCH:
                        flush()
                        size = 0
        flush()
        return [(a / n, b / n, worst) if n else (0.0, 0.0, 0.0) for a, b, n, worst in sums]


def _marks(toxic: list[Counter], clean: list[Counter]) -> list[str]:
    """Landmarks: words with the largest odds of toxic against clean texts, by their support, and a repeatable draw of words of clean ones."""
    import numpy as np

    up, down = Counter(w for x in toxic for w in x), Counter(w for x in clean for w in x)
    ups, downs = len(toxic) + 1, len(clean) + 1
    odds = {w: n**0.5 * float(np.log((n + 0.5) / ups) - np.log((down[w] + 0.5) / downs)) for w, n in up.items() if len(w) > 2 and n > 1}
    telling = sorted(odds, key=lambda w: (-odds[w], w))[: LANDMARKS * 2 // 3]
    other = sorted(w for w in down if len(w) > 2)
    drawn = np.random.default_rng(5).permutation(len(other))[:LANDMARKS]
    return list(dict.fromkeys([*telling, *(other[i] for i in drawn)]))[:LANDMARKS]


def train(toxic: list[str], clean: list[str]) -> Machine | None:
    """A machine from labelled texts; None where a kind has no words."""
    import numpy as np

    texts = [[Counter(p) for p in passages(x)] for x in (*toxic, *clean)]
    bags = [sum(x, Counter()) for x in texts]
    marks = _marks(bags[: len(toxic)], bags[len(toxic) :])
    owner = [i for i, x in enumerate(texts) for p in x if p]
    instances = [p for x in texts for p in x if p]
    y = np.array([i < len(toxic) for i in owner], "f8")
    if not marks or not y.any() or y.all():
        return None
    vocabulary = list(dict.fromkeys(w for p in instances for w in p))
    at = {w: i for i, w in enumerate(vocabulary)}
    landmarks = Landmarks(marks)
    table = np.concatenate([landmarks.kernels(vocabulary[i : i + 4000]) for i in range(0, len(vocabulary), 4000)])
    values, turn = np.linalg.eigh(landmarks.kernels(marks).astype("f8"))
    root = turn * np.where(values > 1e-3, 1 / np.sqrt(np.maximum(values, 1e-3)), 0.0)
    share = [np.fromiter(p.values(), "f4", len(p)) for p in instances]
    x = np.stack([s @ table[[at[w] for w in p]] / s.sum() for p, s in zip(instances, share, strict=True)]).astype("f8") @ root
    scale = 10 / np.sqrt((x * x).sum(axis=1).mean())
    size = np.array([s.sum() for s in share]) / PASSAGE
    w = squared_hinge(x * scale, y, size * np.where(y > 0, size[y == 0].sum() / size[y > 0].sum(), 1.0))
    weights = root @ w[:-1]
    value = table @ weights
    often = np.zeros(len(vocabulary))
    for p, s, toxic_one in zip(instances, share, y, strict=True):
        if not toxic_one:
            often[[at[w] for w in p]] += s
    mean = float((often * value).sum() / often.sum())
    noise = float(np.sqrt((often * (value - mean) ** 2).sum() / often.sum())) or 1.0
    return Machine(marks, weights, noise)


def _curve(values):
    """What the logistic curve sees of the values: densities also as logarithms."""
    import numpy as np

    x = np.asarray(values, "f8").reshape(-1, 3)
    return np.column_stack([x[:, 0], np.log(x[:, 1] + 0.01), np.log(x[:, 2] + 0.01)])


def learn(toxic: list[str], clean: list[str]):
    """(machine or None, slopes, shift). The curve is fitted on texts that the machine in question was not trained on, by halves."""
    import numpy as np

    found, y = [], []
    for half in (0, 1):
        machine = train(toxic[half::2], clean[half::2])
        if machine is None:
            break
        found += machine.values(toxic[1 - half :: 2]) + machine.values(clean[1 - half :: 2])
        y += [1] * len(toxic[1 - half :: 2]) + [0] * len(clean[1 - half :: 2])
    machine = train(toxic, clean) if found else None
    if machine is None:
        return None, *labelled.logistic_fit(np.zeros((len(toxic) + len(clean), 3)), [1] * len(toxic) + [0] * len(clean), 3)
    return machine, *labelled.logistic_fit(_curve(found), y, 3, even=True)


def fit(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, characters: int = CHARACTERS):
    """((marks, weights, noise) or None, slopes, shift): `learn` on labelled rows of docs.

    These are at most `texts` of each kind and about `characters` characters of each (see `labelled.drawn`). One task learns from them,
    as tables of words take hundreds of MB; the driver gets what was learned only.
    """
    rows = labelled.drawn(docs, labels, "toxic", MODULUS, REMAINDER, texts, characters)

    def teach(batches):
        import pickle

        import pyarrow as pa

        found = sorted(x for b in batches for x in zip(*(b.column(k).to_pylist() for k in ("draw", "text", "y")), strict=True))
        out = _told(learn(*([text for _, text, y in found if y == kind] for kind in (1, 0))))
        del found
        yield pa.RecordBatch.from_pydict({"learned": pa.array([pickle.dumps(out)], pa.binary())})

    got = rows.coalesce(1).mapInArrow(common.giving_back(teach), "learned binary").collect()
    if not got:
        return _told(learn([], []))
    import pickle

    return pickle.loads(got[0]["learned"])


def _told(learned):
    """What is needed to build what was learned again."""
    machine, slopes, shift = learned
    return machine and (machine.marks, machine.weights, machine.noise), slopes, shift


def _score(docs: DataFrame, labels: DataFrame, texts: int, characters: int):
    """A function of a text column: its score. Only the texts pass through the workers."""
    machine, slopes, shift = fit(docs, labels, texts, characters)
    marks, weights, noise = machine or ([], None, 1.0)
    held: dict = {}

    @F.arrow_udf("double")
    def score(text):
        import pyarrow as pa

        if weights is None:
            return pa.array(labelled.logistic(slopes, shift, [[0.0] * 3] * len(text)))
        common.remembered()
        if "machine" not in held:
            held["machine"] = Machine(marks, weights, noise)
        found = _curve(held["machine"].values(x.as_py() for x in text))
        common.give_back()
        return pa.array(labelled.logistic(slopes, shift, found))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, texts: int = TEXTS, characters: int = CHARACTERS) -> DataFrame:
    """A row (doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels (doc_id, toxic) teach.

    Null, empty and blank texts score as texts whose words tell nothing. Rows without doc_id are scored and not held out; repeated rows score
    alike; an empty table gives no rows. Without labels of both kinds every text scores the share of toxic labels. Whole texts are scored,
    passage by passage; nothing is shuffled.
    """
    docs = common.documents(docs)
    score = _score(docs, labels, texts, characters)
    out = docs.select("doc_id", labelled.held_out(MODULUS, REMAINDER).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, texts: int = TEXTS, characters: int = CHARACTERS) -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic (see `classify`). Columns of any name pass unchanged."""
    score = _score(common.documents(docs), labels, texts, characters)
    return docs.where(score(F.col("text").cast("string")) < threshold)
