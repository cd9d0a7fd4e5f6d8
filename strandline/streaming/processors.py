"""Stateful processors: anchored post statistics, as-of frequency, the adaptive clustering window with its model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from strandline.functions import control
from strandline.operators.activity import lloyd, merge_clusters
from strandline.storage import read_lines


class PostStatistics(StatefulProcessor):
    """Windows anchored at a post's first event, one each slide while the post is awake; the rules of operators.statistics.anchored.

    Events stay in state while a window can hold them. A timer at each window's end emits it once the watermark is past; one whose
    window is empty puts the post to sleep, and later events set a new anchor. Events before the open window are dropped. A window's row also
    tells how many events came since the one before: ahead of the open slide, in it, in an older one of the window, and before the window.
    """

    OUTPUT = "post_id long, window_us long, comment_count long, reply_count long, like_count long, distinct_users long, new_post boolean, ahead long, current long, older long, dropped long"

    def __init__(self, window_us: int, slide_us: int, count_author: bool = False):
        self.window, self.slide, self.count_author = window_us, slide_us, count_author

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t long, kind string, person long")
        self.due = handle.getValueState("due", "t long")
        self.came = handle.getValueState("came", "ahead long, current long, older long, dropped long")

    def _arm(self, t: int) -> None:
        self.due.update((t,))
        self.handle.registerTimer(-(-t // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, due = None, self.due.get()[0] if self.due.exists() else None
        came = list(self.came.get()) if self.came.exists() else [0, 0, 0, 0]
        for pdf in rows:
            found = list(zip(pdf["t"].astype("int64").tolist(), pdf["event_type"].tolist(), pdf["person_id"].astype("int64").tolist()))
            if due is not None:
                for t, _, _ in found:
                    came[0 if t >= due else 1 if t >= due - self.slide else 2 if t >= due - self.window else 3] += 1
                found = [x for x in found if x[0] >= due - self.window]
            else:
                came[0] += len(found)
            if found:
                self.events.appendList(found)
                low = min(x[0] for x in found)
                first = low if first is None else min(first, low)
        self.came.update(tuple(came))
        if first is not None and due is None:
            self._arm(first + self.slide)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (due,), mark = self.due.get(), timerValues.getCurrentWatermarkInMs() * 1000
        kept, out = sorted(self.events.get()), []
        came = self.came.get() if self.came.exists() else (0, 0, 0, 0)
        while due is not None and due <= mark:
            kept = [e for e in kept if e[0] >= due - self.window]
            now = [e for e in kept if e[0] < due]
            if now:
                kinds = [e[1] for e in now]
                people = {e[2] for e in now if self.count_author or e[1] != "Post"}
                out.append((key[0], due, kinds.count("Comment"), kinds.count("Reply"), kinds.count("Like"), len(people), "Post" in kinds, *came))
                came = (0, 0, 0, 0)
            if now or any(e[0] == due for e in kept):
                due += self.slide
            else:
                due = kept[0][0] + self.slide if kept else None
        self.came.update(tuple(came))
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()
        if due is None:
            self.due.clear()
        else:
            self._arm(due)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUTPUT.split(", ")]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class AsOfFrequency(StatefulProcessor):
    """Events of a person with the newest count that arrived before them, 0 if none or one older than the limit.

    Rows are tagged: a count has is_count and n, an event its id. Rows of one batch are taken in order of time, counts first.
    """

    OUTPUT = "event_id long, person_id long, t long, n long"

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "t long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["t", "is_count"], ascending=[True, False])
        last, out = self.last.get() if self.last.exists() else None, []
        for t, is_count, n, event in zip(found["t"].tolist(), found["is_count"].tolist(), found["n"].tolist(), found["event_id"].tolist()):
            if is_count:
                last = (int(t), int(n))
            else:
                out.append((int(event), int(key[0]), int(t), last[1] if last and last[0] >= t - self.limit else 0))
        if last:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["event_id", "person_id", "t", "n"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class ClusterUpdates(StatefulProcessor):
    """The adaptive window and the clustering model of a stream of points, in the state of one key: a window holds at most so many points.

    Points of a batch are taken in order of time; the watermark closes windows. Each closed window updates the model and gives a row for each cluster, and
    one row of metadata: how far the centroids moved, how weights and k changed, and how many points came ahead of, inside and behind the window,
    and whether it fired early (full), regularly or delayed (extended). Parameters are read from the control file at each batch, so that changes count
    from the next update on. All is in the query's checkpoint: a restarted query goes on where it was.
    """

    OUTPUT = (
        "kind string, version long, end_us long, index int, centroid array<double>, weight double, label string, average_distance double, "
        "average_weight_difference double, k_difference int, points long, firing string, ahead long, inside long, behind long"
    )
    NAMES = [c.split()[0] for c in OUTPUT.split(", ")]

    def __init__(self, size_us: int, least: int, most: int, k: int, decay: float, control: str | None = None):
        self.size, self.least, self.most, self.k, self.decay, self.control = size_us, least, most, k, decay, control

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "end long, extended boolean, ahead long, inside long, behind long")
        self.points = handle.getValueState("points", "width long, features binary")
        self.later = handle.getMapState("later", "end long, part long", "features binary")
        self.ends = handle.getValueState("ends", "width long, ends array<long>, parts array<long>")
        self.model = handle.getListState("model", "index int, centroid array<double>, weight double")
        self.version = handle.getValueState("version", "version long")

    def _load(self) -> None:
        self.now = AdaptiveWindow(self.size, self.least, self.most, Waiting(self.later, self.ends))
        self.came = [0, 0, 0]
        if self.window.exists():
            end, extended, *came = self.window.get()
            self.now.end, self.now.extended, self.came = (None if end < 0 else end), extended, came
        self.now.points = list(unpacked(*self.points.get())) if self.points.exists() else []
        self.clusters = StreamingClusters(self.k, self.decay)
        if self.control:
            self.clusters.configure(control.read(read_lines(self.control)))
        self.clusters.model = [(i, np.array(c), w) for i, c, w in self.model.get()] if self.model.exists() else []
        self.clusters.version = self.version.get()[0] if self.version.exists() else 0

    def _save(self) -> None:
        self.window.update((-1 if self.now.end is None else self.now.end, self.now.extended, *self.came))
        if self.now.points:
            self.points.update(packed(np.array(self.now.points, float)))
        else:
            self.points.clear()
        self.now.later.save()
        if self.clusters.model:
            self.model.put([(i, [float(x) for x in c], float(w)) for i, c, w in self.clusters.model])
        else:
            self.model.clear()
        self.version.update((self.clusters.version,))
        if self.now.end is not None:
            self.handle.registerTimer(-(-self.now.end // 1000))

    def _updates(self, closed: Iterable[tuple[int, list, str]]) -> list[tuple]:
        out = []
        for end, points, firing in closed:
            before = {i: (c, w) for i, c, w in self.clusters.model}
            model, version = self.clusters.update(points), self.clusters.version
            out += [("model", version, end, i, [float(x) for x in c], float(w), label) + (None,) * 8 for i, c, w, label in model]
            both = [(c, w, *before[i]) for i, c, w, _ in model if i in before]
            distance = float(np.mean([np.linalg.norm(c - c0) for c, _, c0, _ in both])) if both else None
            weight = float(np.mean([w - w0 for _, w, _, w0 in both])) if both else None
            out.append(("metadata", version, end, None, None, None, None, distance, weight, len(model) - len(before), len(points), firing, *self.came))
            self.came = [0, 0, 0]
        return out

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.NAMES).astype({"index": "Int32", "k_difference": "Int32", "points": "Int64", "ahead": "Int64", "inside": "Int64", "behind": "Int64"}) if out else pd.DataFrame()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        times, points, out = [], [], []
        for pdf in rows:
            pdf = pdf[pdf["features"].notna()]
            if len(pdf):
                times.append(pdf["t"].to_numpy("int64"))
                points.append(np.array(pdf["features"].tolist(), float))
        if times:
            t, p = np.concatenate(times), np.concatenate(points)
            order = np.argsort(t, kind="stable")
            out = self._add(t[order], p[order])
        self._save()
        yield self._frame(out)

    def _add(self, t: np.ndarray, points: np.ndarray) -> list[tuple]:
        """Points in order of time: those before the open window's end join it, up to where it is full, the others wait."""
        now, out, at = self.now, [], 0
        now.begin(int(t[0]))
        behind, inside = np.searchsorted(t, [now.end - self.size, now.end])
        while at < inside:
            stop = min(inside, at + now.room())
            late = max(0, min(stop, behind) - at)
            self.came[1] += int(stop - at - late)
            self.came[2] += int(late)
            out += self._updates(now.join(points[at:stop]))
            at = stop
        self.came[0] += int(len(t) - inside)
        ends = (t[inside:] // self.size + 1) * self.size
        for end in np.unique(ends):
            low, high = np.searchsorted(ends, [end, end + 1])
            now.later.add(int(end), points[inside + low : inside + high])
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = self._updates(self.now.closed(timerValues.getCurrentWatermarkInMs() * 1000))
        self._save()
        yield self._frame(out)

    def close(self) -> None:
        pass


def packed(points: np.ndarray) -> tuple[int, bytes]:
    return points.shape[1], points.astype("<f8").tobytes()


def unpacked(width: int, values: bytes) -> np.ndarray:
    return np.frombuffer(bytes(values), "<f8").reshape(-1, width)


class Waiting:
    """Points by the end of the window that they are for, in state, packed: one window's are read at a time, when it opens."""

    PART = 100_000

    def __init__(self, state, ends):
        self.state, self.known = state, ends
        self.width, names, parts = ends.get() if ends.exists() else (0, [], [])
        self.parts = dict(zip(names, parts))

    def __iter__(self) -> Iterator[int]:
        return iter(self.parts)

    def add(self, end: int, points: np.ndarray) -> None:
        for at in range(0, len(points), self.PART):
            self.width, values = packed(points[at : at + self.PART])
            number = self.parts.get(end, 0)
            self.state.updateValue((end, number), (values,))
            self.parts[end] = number + 1

    def pop(self, end: int, default):
        if end not in self.parts:
            return default
        keys = [(end, i) for i in range(self.parts.pop(end))]
        found = np.concatenate([unpacked(self.width, self.state.getValue(k)[0]) for k in keys])
        for k in keys:
            self.state.removeKey(k)
        return found

    def save(self) -> None:
        self.known.update((self.width, list(self.parts), list(self.parts.values())))


class AdaptiveWindow:
    """Collects points in tumbling windows that close early at a most, and go on to the next window if they have too few.

    add() takes (time, point); advance() gives the points of every window that the watermark closes. Both give (end, points, firing): early if the window is full,
    delayed if it was extended, regular if not. A window closes at its end with more than least points; one that was extended closes with least or more.
    Points for later windows wait by the end of theirs. Late points join the open window.
    """

    def __init__(self, size: int, least: int, most: int, later=None):
        self.size, self.least, self.most = size, least, most
        self.end, self.extended, self.points, self.later = None, False, [], {} if later is None else later

    def begin(self, t: int) -> None:
        if self.end is None:
            self.end = (t // self.size + 1) * self.size

    def room(self) -> int:
        return max(1, self.most - len(self.points))

    def join(self, points) -> Iterator[tuple[int, list, str]]:
        """Points of the open window, which closes whenever it is full."""
        at = 0
        while at < len(points):
            taken = points[at : at + self.room()]
            self.points.extend(taken)
            at += len(taken)
            if len(self.points) >= self.most:
                full, self.points, self.extended = self.points, [], False
                yield self.end, full, "early"

    def add(self, t: int, point) -> list[tuple[int, list, str]]:
        self.begin(t)
        if t >= self.end:
            self.later.setdefault((t // self.size + 1) * self.size, []).append(point)
            return []
        return list(self.join([point]))

    def closed(self, watermark: int) -> Iterator[tuple[int, list, str]]:
        while self.end is not None and watermark >= self.end:
            enough = len(self.points) >= self.least if self.extended else len(self.points) > self.least
            if enough:
                closing = self.end, self.points, "delayed" if self.extended else "regular"
                self.points, self.extended = [], False
                yield closing
            elif self.points:
                self.extended = True
            first = min(self.later, default=None)
            if first is None and not self.points:
                self.end = None
                break
            self.end = self.end + self.size if self.points or first is None else first
            yield from self.join(self.later.pop(self.end, []))

    def advance(self, watermark: int) -> list[tuple[int, list, str]]:
        return list(self.closed(watermark))


class StreamingClusters:
    """The clustering model: updated by each closed window, with parameters that may change between windows."""

    def __init__(self, k: int = 4, decay: float = 0.2):
        self.k, self.decay, self.labels = k, decay, {}
        self.model: list[tuple[int, np.ndarray, float]] = []
        self.version = 0

    def configure(self, parameters: dict[str, str]) -> None:
        self.k = int(parameters.get("k", self.k))
        self.decay = float(parameters.get("decay", self.decay))
        self.labels |= {int(name.partition(":")[2]): value for name, value in parameters.items() if name.startswith("label:")}

    def update(self, points: list) -> list[tuple[int, np.ndarray, float, str | None]]:
        data = np.array(points, float)
        new = lloyd(data, self.model, self.k)
        self.model = merge_clusters(self.model, new, self.decay)
        self.version += 1
        return [(i, c, w, self.labels.get(i)) for i, c, w in self.model]
