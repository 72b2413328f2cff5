"""Where a text is cut into chunks."""

from __future__ import annotations

from collections.abc import Iterator

SIZE, OVERLAP, LOOK_BACK, LEAST = 8000, 150, 1200, 1000


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP, look_back: int = LOOK_BACK, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a stripped text: cut at the last blank line, else line feed, near the end of each."""
    n, start = len(text), 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            low = max(end - look_back, start)
            cut = text.rfind("\n\n", low, end)
            cut = cut if cut >= 0 else text.rfind("\n", low, end)
            if cut > start + least:
                end = cut
        yield start, end
        if end >= n:
            return
        start = max(end - overlap, start + 1)
