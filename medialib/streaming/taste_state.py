"""The taste of one viewer in one library as keyed streaming state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from medialib.operators.taste import DAY_MS, HALF_LIFE_DAYS

#: One row a changed bucket, and one with a null key for when the viewer last learned.
CHANGES = ("viewer_id BIGINT, library_id STRING, key STRING, likes DOUBLE, dislikes DOUBLE, last_seen_ms BIGINT, "
           "learned_at_ms BIGINT, gone BOOLEAN")


def fade(likes: float, dislikes: float, elapsed_ms: float) -> tuple[float, float] | None:
    """A bucket after some time: nothing happens before half a half-life, nearly empty ones vanish (None)."""
    halvings = elapsed_ms / (HALF_LIFE_DAYS * DAY_MS)
    if halvings < 0.5:
        return likes, dislikes
    factor = 0.5 ** halvings
    likes, dislikes = likes * factor, dislikes * factor
    return (likes, dislikes) if likes + dislikes >= 1.0 else None


class TasteProcessor(StatefulProcessor):
    """Fades the buckets a viewer had by the time since it last learned, then adds the batch's votes.

    ``learned_at`` starts at the batch's ``now_ms`` and follows the newest vote. State: one value with all buckets of the
    viewer, read once and written once a batch; every other call would be a round trip to the state store per bucket.
    """

    def __init__(self, fading: bool):
        self.fading = fading

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taste = handle.getValueState("taste", (
            "at_ms bigint, keys array<string>, likes array<double>, dislikes array<double>, last_seen_ms array<bigint>"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, votes = 0, {}
        for some in rows:
            now = max(now, int(some["now_ms"].max()))
            voted = some[some["key"].notna()]
            for name, liked, disliked, at in zip(*(voted[c].tolist() for c in ("key", "liked", "disliked", "at_ms")), strict=True):
                had = votes.get(name, (0.0, 0.0, 0))
                votes[name] = (had[0] + liked, had[1] + disliked, max(had[2], int(at)))
        stamp, buckets = None, {}
        if self.taste.exists():
            stamp, *columns = self.taste.get()
            buckets = {name: tuple(bucket) for name, *bucket in zip(*columns, strict=True)}
        changed: dict[str, tuple[float, float, int] | None] = {}
        if self.fading and stamp is not None:
            for name, (likes, dislikes, seen) in buckets.items():
                left = fade(likes, dislikes, now - stamp)
                if left != (likes, dislikes):
                    changed[name] = None if left is None else (*left, seen)
        for name, (likes, dislikes, at) in votes.items():
            had = (changed[name] if name in changed else buckets.get(name)) or (0.0, 0.0, 0)
            changed[name] = (had[0] + likes, had[1] + dislikes, max(int(had[2]), at))
        kept = {name: bucket for name, bucket in (buckets | changed).items() if bucket is not None}
        stamp = max([stamp if stamp is not None else now, *(at for _, _, at in votes.values())])
        self.taste.update((stamp, list(kept), *([bucket[k] for bucket in kept.values()] for k in range(3))))
        yield pd.DataFrame({
            "viewer_id": key[0], "library_id": key[1], "key": [*changed, None],
            "likes": [b[0] if b else 0.0 for b in changed.values()] + [0.0],
            "dislikes": [b[1] if b else 0.0 for b in changed.values()] + [0.0],
            "last_seen_ms": [int(b[2]) if b else 0 for b in changed.values()] + [0],
            "learned_at_ms": [0] * len(changed) + [stamp], "gone": [b is None for b in changed.values()] + [False]})

    def close(self) -> None:
        pass
