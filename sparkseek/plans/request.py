"""A search request, and the settings that shape an answer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

DEFAULT_LIMIT, MAX_LIMIT = 200, 500
MODES = ("all", "text", "visual")

# Thresholds and weights of the rankings.
NEAR_BELOW = 30
MIN_VISUAL, MIN_SIMILAR, MIN_HYBRID = 0.25, 0.72, 0.55
RRF_K = 60
COLUMN_WEIGHTS = {"name": 4.0, "text": 1.0, "note": 1.0, "user_tags": 2.0}


@dataclass(frozen=True)
class SearchRequest:
    q: str = ""
    mode: str | None = None
    sort: str | None = None
    limit: int | None = None
    offset: int = 0
    similar_to: int | None = None
    image: Sequence[float] | bytes | None = None
    image_path: str | None = None
    expand_group: int | None = None
    shuffle: bool = False

    @property
    def page(self) -> int:
        return min(MAX_LIMIT, max(1, DEFAULT_LIMIT if self.limit is None else self.limit))

    @property
    def lane(self) -> str:
        """The mode, with every unknown one taken as all."""
        return self.mode if self.mode in ("text", "visual") else "all"

    #: An id comes before a path, and a path before an image's own bytes.
    @property
    def wants_image(self) -> bool:
        return self.similar_to is not None or self.image_path is not None or self.image is not None

    @property
    def feedback_key(self) -> str:
        return self.q.strip().lower()
