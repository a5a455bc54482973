"""Sequential folds: operators whose state depends on their own past decisions.

Each fold is a small class with ``step(*readings) -> tuple``. Its state is typed: ``values``, a tuple of the columns ``keeps``, and, for
folds over a window, ``window``, a tuple of rows of the columns ``holds``. The same class runs in batch (``fold_batch``) and in a
stateful stream (``streaming.stateful``, which keeps ``values`` as a value and ``window`` as a list), so both give the same rows
for the same order of input.

``fold_batch`` clusters rows by key, sorts them within each partition and streams them through the fold as Arrow batches, so a
long session never has to fit in memory. Columns that a fold doesn't read pass untouched, and keys are compared as they are: rows with a null
key are one session. A NaN counts as a null reading; what a null reading does is told in each fold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from curata.operators import arrow


class Fold:
    """``reads`` columns, ``gives`` columns; the state's columns are ``keeps`` and, of a window, ``holds``."""

    reads: tuple[str, ...] = ()
    gives = ""
    keeps = ""
    holds = ""
    values: tuple = ()
    window: tuple = ()

    def step(self, *readings) -> tuple:
        raise NotImplementedError


class Stabilizer(Fold):
    """EMA of confidence, majority over a window, hysteresis lock.

    Gives (label, ema, majority, is_locked, lock_count, is_uncertain, window_size). While a change is pending the locked label is
    given, otherwise the majority; ties go to the label that is first in the window. A null label is ``unknown``; a null confidence
    leaves the average as it is, and without an average a row is uncertain."""

    reads = ("label", "confidence")
    gives = "stable_label string, ema double, majority string, is_locked boolean, lock_count int, is_uncertain boolean, window_size int"
    keeps = "ema double, locked string, count int"
    holds = "label string"

    def __init__(self, alpha: float = 0.2, window: int = 15, lock_frames: int = 5, threshold: float = 0.7):
        self.alpha, self.length, self.lock_frames, self.threshold = alpha, window, lock_frames, threshold
        self.values, self.window = (None, None, 0), ()

    def step(self, label, confidence):
        ema, locked, count = self.values
        label = label or "unknown"
        if confidence is not None:
            confidence = min(1.0, max(0.0, confidence))
            ema = confidence if ema is None else self.alpha * confidence + (1.0 - self.alpha) * ema
        self.window = (*self.window, (label,))[-self.length :]
        top = Counter(x for (x,) in self.window).most_common(1)[0][0]  # of equals, the first met
        pending = bool(locked) and label != locked and count + 1 < self.lock_frames
        locked, count = (locked, count + 1) if pending else (label, 0)
        self.values = (ema, locked, count)
        return (locked if pending else top, ema, top, pending, count, ema is None or ema < self.threshold, len(self.window))


class Ema(Fold):
    """Exponential moving average; the first value seeds it. Null values change nothing."""

    reads = ("_value",)
    gives = "ema double"
    keeps = "ema double"

    def __init__(self, alpha: float = 0.2):
        self.alpha = alpha
        self.values = (None,)

    def step(self, value):
        (ema,) = self.values
        if value is not None:
            self.values = (value if ema is None else self.alpha * value + (1.0 - self.alpha) * ema,)
        return self.values


class OutlierSmoother(Fold):
    """EMA over values within ``limit`` population deviations of the last accepted ones; until ``least`` values are accepted the
    raw value is given. A null value is no outlier, changes nothing and gets the average, or null until ``least`` values are accepted.

    A value is tested as a square: (n v - sum)^2 against limit^2 (n sum of squares - sum^2), taken relative to the first of the window, so
    that equal values have a spread of exactly 0."""

    reads = ("confidence",)
    gives = "smoothed double, is_outlier boolean"
    keeps = "average double"
    holds = "accepted double"

    def __init__(self, window: int = 5, limit: float = 2.0, least: int = 3):
        self.length, self.least = window, least
        self.limit, self.alpha = limit * limit, 2.0 / (window + 1.0)
        self.values, self.window = (None,), ()

    def _far(self, value: float) -> bool:
        away = [x - self.window[0][0] for (x,) in self.window]
        n, total = len(away), sum(away)
        spread = n * sum(x * x for x in away) - total * total
        return n > 1 and spread > 0 and (n * (value - self.window[0][0]) - total) ** 2 > self.limit * spread

    def step(self, value):
        far = value is not None and self._far(value)
        (average,) = self.values
        if value is not None and not far:
            average = value if average is None else average + self.alpha * (value - average)
            self.values, self.window = (average,), (*self.window, (value,))[-self.length :]
        return (average if len(self.window) >= self.least else value, far)


class AdaptiveThreshold(Fold):
    """A threshold that moves by ``step_size`` within bounds, at most once in ``interval`` seconds of event time: down where the judged
    predictions of the window that were right lie below it on average, else up where the wrong ones lie above it.

    A row without confidence or without a verdict doesn't enter the window; without a time it moves nothing; without a confidence it is neither
    accepted nor refused (null). The means are null while the window is empty."""

    reads = ("time", "confidence", "is_correct")
    gives = "threshold double, accepted boolean, mean_confidence double, accuracy double"
    keeps = "threshold double, moved double"
    holds = "confidence double, is_correct boolean"

    def __init__(self, start: float = 0.5, low: float = 0.3, high: float = 0.9, window: int = 20, step_size: float = 0.01, interval: float = 5.0):
        self.bounds, self.length, self.step_size, self.interval = (low, high), window, step_size, interval
        self.values, self.window = (start, None), ()

    def _mean(self, verdict: bool) -> float | None:
        chosen = [c for c, right in self.window if right is verdict]
        return sum(chosen) / len(chosen) if chosen else None

    def _pull(self, threshold: float) -> int:
        """-1, 0 or 1: where the window draws the threshold."""
        right, wrong = self._mean(True), self._mean(False)
        if right is None or wrong is None or len(self.window) < self.length // 2:
            return 0
        return -1 if right < threshold else int(wrong > threshold)

    def step(self, time, confidence, is_correct):
        threshold, moved = self.values
        if confidence is not None and is_correct is not None:
            self.window = (*self.window, (confidence, bool(is_correct)))[-self.length :]
        if time is not None and (moved is None or time - moved >= self.interval):
            low, high = self.bounds
            threshold, moved = min(high, max(low, threshold + self._pull(threshold) * self.step_size)), time
        self.values = (threshold, moved)
        n = len(self.window)
        means = (sum(c for c, _ in self.window) / n, sum(right for _, right in self.window) / n) if n else (None, None)
        return (threshold, None if confidence is None else confidence >= threshold, *means)


class Cadence(Fold):
    """Whether to classify a frame, by the first rule that applies:

    too soon (within ``least_ms``): no; overdue (``most_ms``): yes; unsure (confidence null or under ``threshold``): yes; a new class: yes;
    settled (the ``stable_frames``-th steady frame or later): only from 2 x ``least_ms`` on; steady: yes.
    Steady frames are counted anew after any other rule but the first has applied, and after a settled object was classified.
    A frame without a time is not classified and changes nothing."""

    reads = ("time", "confidence", "label")
    gives = "classify boolean"
    keeps = "time double, steady int, label string"

    def __init__(self, least_ms: float = 100.0, most_ms: float = 1000.0, stable_frames: int = 3, threshold: float = 0.7):
        self.least_ms, self.most_ms, self.stable_frames, self.threshold = least_ms, most_ms, stable_frames, threshold
        self.values = (None, 0, None)

    def _rule(self, since: float, confidence, label) -> str:
        _, steady, known = self.values
        rules = {
            "too_soon": since < self.least_ms,
            "overdue": since >= self.most_ms,
            "unsure": confidence is None or confidence < self.threshold,
            "new_class": label is not None and label != known,
            "settled": steady + 1 >= self.stable_frames,
        }
        return next((name for name, applies in rules.items() if applies), "steady")

    def step(self, time, confidence, label):
        if time is None:
            return (False,)
        last, steady, known = self.values
        since = float("inf") if last is None else (time - last) * 1000.0
        rule = self._rule(since, confidence, label)
        if rule == "too_soon":
            return (False,)
        go = rule != "settled" or since >= 2 * self.least_ms
        self.values = (time if go else last, steady + 1 if rule == "steady" or not go else 0, label if rule == "new_class" else known)
        return (go,)


class StableFusion(Fold):
    """Weighted scores, with a credit for a class that stays, which fades within a second, and a debit for one that changes; below
    ``threshold`` the class before is given. A null score is 0; a row without a label or a time has neither credit nor debit."""

    reads = ("time", "detector", "classifier", "label")
    gives = "fused_label string, fused double, bonus double"
    keeps = "label string, time double"

    def __init__(self, detector_weight: float = 0.3, classifier_weight: float = 0.7, threshold: float = 0.5, malus: float = 0.3, bonus: float = 0.05):
        self.weights, self.threshold, self.malus, self.bonus = (detector_weight, classifier_weight), threshold, malus, bonus
        self.values = (None, None)

    def _credit(self, time, label) -> float:
        known, last = self.values
        if None in (time, label, last):
            return 0.0
        return self.bonus * max(0.0, 1.0 - (time - last)) if label == known else -self.malus

    def step(self, time, *scores_and_label):
        *scores, label = scores_and_label
        known, last = self.values
        credit = self._credit(time, label)
        fused = min(1.0, max(0.0, sum(w * (s or 0.0) for w, s in zip(self.weights, scores, strict=True)) + credit))
        candidates = (known, label) if fused < self.threshold else (label,)
        chosen = next((c for c in candidates if c is not None), None)
        self.values = (known if chosen is None else chosen, last if time is None else time)
        return (chosen, fused, credit)


class RateLimit(Fold):
    """Lets a row pass if none did within ``interval`` seconds of event time before it. A row without a time doesn't pass."""

    reads = ("time",)
    gives = "passes boolean"
    keeps = "time double"

    def __init__(self, interval: float = 5.0):
        self.interval = interval
        self.values = (None,)

    def step(self, time):
        (last,) = self.values
        due = time is not None and (last is None or time - last >= self.interval)
        self.values = (time if due else last,)
        return (due,)


class MotionGate(Fold):
    """Whether a level moved by more than ``threshold`` hundredths of its range since the row before; a null level doesn't, nor does the row
    after it."""

    reads = ("level",)
    gives = "moved boolean"
    keeps = "level double"

    def __init__(self, threshold: float = 5.0, span: float = 255.0):
        self.least = threshold / 100.0
        self.span = span
        self.values = (None,)

    def step(self, level):
        (before,), self.values = self.values, (level,)
        return (before is not None and level is not None and abs(level - before) / self.span > self.least,)


class CaptureGate(Fold):
    """True on the frame that completes ``frames`` like-labelled frames whose centres drift by at most ``limit`` of the box's
    diagonal; then it starts anew. A frame without a label or a corner starts it anew too."""

    reads = ("label", "x1", "y1", "x2", "y2")
    gives = "capture boolean, steady int"
    keeps = "label string, x double, y double, steady int"

    def __init__(self, frames: int = 4, limit: float = 0.2):
        self.frames, self.limit = frames, limit
        self.values = self.start = (None, None, None, 0)

    def step(self, label, *corners):
        known, last_x, last_y, steady = self.values
        if not label or None in corners:
            self.values = self.start
            return (False, 0)
        x1, y1, x2, y2 = corners
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        diagonal = (max(x2 - x1, 0) ** 2 + max(y2 - y1, 0) ** 2) ** 0.5
        near = last_x is not None and ((x - last_x) ** 2 + (y - last_y) ** 2) ** 0.5 <= self.limit * diagonal
        steady = steady + 1 if label == known and near else 1
        done = steady >= self.frames
        self.values = self.start if done else (label, x, y, steady)
        return (done, steady)


def readings(values) -> list:
    """A fold's readings: NaN is null."""
    return [None if v != v else v for v in values]


def fold_batch(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Fold], partitions: int | None = None) -> DataFrame:
    """``df`` with a fold's columns: rows of a key go through a new ``fold()`` in the given order, nulls first."""
    from pyspark.sql import types as T

    sample = fold()
    given, reads = T._parse_datatype_string(sample.gives).fields, list(sample.reads)
    schema = T.StructType([*df.schema.fields, *given])

    def run(batches):
        fields = arrow.arrow_fields(given)
        known, machine = None, None
        for batch in batches:
            found = []
            for key, values in zip(arrow.rows(batch, keys), arrow.rows(batch, reads), strict=True):
                if machine is None or not arrow.same_key(key, known):
                    known, machine = key, fold()
                found.append(machine.step(*readings(values)))
            yield arrow.appended(batch, fields, found)

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
