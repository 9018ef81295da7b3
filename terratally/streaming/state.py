"""Keyed state of the frame streams. State ends by event time: what the watermark has passed is kept no longer.

A key is a slot of many videos, because every call into the state costs far more than a row does. Rows carry their event time
as ``ms``, milliseconds since 1970, which is how watermark and timers count.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terratally.operators.stats import NAMES

N = len(NAMES)
PLACE = {name: i for i, name in enumerate(NAMES)}


class SlotFrames(StatefulProcessor):
    """One value per slot, and one timer, which clears it when the watermark has passed all frames of the slot.

    The value holds the open frames, those that later batches may still add to, of all parts (a video and a block of its
    frame numbers) in the slot. The next watermark is at least the newest ``ts`` of the slot less ``late``, so what lies
    before that is closed as soon as its batch is done. A part without open frames is left out; when it goes on after
    that it gets a new ``first`` (its smallest frame number then), which tells its rows from those of the time before.
    """

    STATE = ""
    PART = "part"

    def __init__(self, late: int):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("frames", "timer bigint, " + self.STATE)

    def taken_in(self, rows: Iterable[Row], timerValues) -> tuple[dict, int]:
        """Rows by part, and the time up to which nothing more can come."""
        parts, newest = {}, timerValues.getCurrentWatermarkInMs()
        for r in rows:
            parts.setdefault((r.video_id, r[self.PART]), []).append(r)
            newest = max(newest, r.ms - self.late)
        return parts, newest

    def store(self, before: int | None, last: int | None, *fields) -> None:
        """Keep the open frames, of which ``last`` is the newest time, or nothing where there are none."""
        timer = None if last is None else last + 1
        if before != timer and before is not None:
            self.handle.deleteTimer(before)
        if timer is None:
            self.value.clear()
            return
        self.value.update((timer, *fields))
        if before != timer:
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        yield from ()

    def close(self) -> None:
        pass


class RunningTotals(SlotFrames):
    """Totals of the frames of a part: number of frames, and count, area and presence per category.

    State: the totals of the parts with open frames, and the sums of these frames. A frame that leaves takes nothing with
    it, since the totals hold it already.
    """

    STATE = ("video array<bigint>, part array<int>, first array<int>, frames array<bigint>, counts array<bigint>, areas array<double>, "
             "present array<bigint>, owner array<int>, frame array<int>, ts array<bigint>, c array<bigint>, a array<double>")
    OUT = "video_id bigint, part int, first int, frames bigint, counts array<bigint>, areas array<double>, present array<bigint>"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.value.get()
        before, totals, open_ = None, {}, {}
        if old is not None:
            before, video, part, first, n, counts, areas, present, owner, frame, ts, c, a = old
            keys = list(zip(video, part))
            wide = lambda v, i: list(v[i * N:i * N + N])
            for i, k in enumerate(keys):
                totals[k], open_[k] = [first[i], n[i], wide(counts, i), wide(areas, i), wide(present, i)], {}
            for i, o in enumerate(owner):
                open_[keys[o]][frame[i]] = [ts[i], wide(c, i), wide(a, i)]
        parts, passed = self.taken_in(rows, timerValues)
        for k, own in parts.items():
            frames = open_.setdefault(k, {})
            total = totals.setdefault(k, [min(r.frame_idx for r in own), 0, [0] * N, [0.0] * N, [0] * N])
            _, _, counts, areas, present = total
            for r in own:
                one = frames.get(r.frame_idx)
                if one is None:
                    one = frames[r.frame_idx] = [r.ms, [0] * N, [0.0] * N]
                    total[1] += 1
                one[0] = max(one[0], r.ms)
                p = PLACE.get(r.category)
                if p is not None:
                    cnt, area = r.cnt or 0, r.area_px or 0.0
                    seen = one[1][p] > 0 or one[2][p] > 0
                    one[1][p] += cnt
                    one[2][p] += area
                    counts[p] += cnt
                    areas[p] += area
                    present[p] += (one[1][p] > 0 or one[2][p] > 0) - seen
        left = {k: live for k, v in open_.items() if (live := {f: x for f, x in v.items() if x[0] > passed})}
        kept = [totals[k] for k in left]
        flat = lambda lists: [x for one in lists for x in one]
        state = [(i, f, *x) for i, v in enumerate(left.values()) for f, x in v.items()]
        self.store(before, max((x[2] for x in state), default=None), [k[0] for k in left], [k[1] for k in left], [t[0] for t in kept], [t[1] for t in kept],
                   *[flat(t[i] for t in kept) for i in (2, 3, 4)], *[[x[i] for x in state] for i in (0, 1, 2)], *[flat(x[i] for x in state) for i in (3, 4)])
        for k in parts:
            first, n, counts, areas, present = totals[k]
            yield Row(video_id=k[0], part=k[1], first=first, frames=n, counts=counts, areas=areas, present=present)


class CarrySampled(SlotFrames):
    """Frames of one block of a video with what the last sampled frame of the block showed.

    State: the open frames, and the last sampled one before them. A row comes out again when a later batch changes what it
    shows. ``seen`` is null, and ``known`` false, where the part has no sampled frame before; ``tail`` rows name the last
    sampled frame of the part, for the blocks after it.
    """

    PART = "block"
    STATE = ("video array<bigint>, block array<int>, first array<int>, owner array<int>, frame array<int>, ts array<bigint>, "
             "seen array<array<struct<category: string, cnt: int, area_px: double>>>")
    OUT = ("video_id bigint, frame_idx int, tail boolean, first int, sampled boolean, known boolean, "
           "seen array<struct<category: string, cnt: int, area_px: double>>")

    def __init__(self, stride: int, late: int):
        super().__init__(late)
        self.stride = stride

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.value.get()
        before, firsts, open_ = None, {}, {}
        if old is not None:
            before, video, block, first, owner, frame, ts, seen = old
            keys = list(zip(video, block))
            firsts, open_ = dict(zip(keys, first)), {k: {} for k in keys}
            for o, f, t, s in zip(owner, frame, ts, seen):
                open_[keys[o]][f] = [t, list(map(tuple, s))]
        parts, passed = self.taken_in(rows, timerValues)
        for k, own in parts.items():
            frames, changed = open_.setdefault(k, {}), set()
            for r in own:
                one = frames.setdefault(r.frame_idx, [r.ms, []])
                one[0] = max(one[0], r.ms)
                one[1].append((r.category, r.cnt, r.area_px))
                changed.add(r.frame_idx)
            first = firsts.setdefault(k, min(frames))
            source, moved = None, False
            for f in sorted(frames):
                sampled = (f - 1) % self.stride == 0
                if sampled:
                    source, moved = f, f in changed
                if moved or f in changed:
                    yield Row(video_id=k[0], frame_idx=f, tail=False, first=first, sampled=sampled, known=source is not None,
                              seen=None if source is None else frames[source][1])
            if source is not None and any((f - 1) % self.stride == 0 for f in changed):
                yield Row(video_id=k[0], frame_idx=source, tail=True, first=first, sampled=True, known=True, seen=frames[source][1])
        state, left = [], []
        for k, frames in open_.items():
            if all(x[0] <= passed for x in frames.values()):
                continue
            shown = max((f for f, x in frames.items() if x[0] <= passed and (f - 1) % self.stride == 0), default=None)
            state += [(len(left), f, *frames[f]) for f in sorted(frames) if frames[f][0] > passed or f == shown]
            left.append(k)
        self.store(before, max((x[2] for x in state), default=None), [k[0] for k in left], [k[1] for k in left], [firsts[k] for k in left],
                   *[[x[i] for x in state] for i in range(4)])
