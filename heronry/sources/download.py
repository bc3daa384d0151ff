"""Getting a dump file before Spark reads it, by any getter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path


def download(target: str, size: Callable[[], int], read: Callable[[int], tuple[bool, Iterator[bytes]]]) -> Path:
    """The file at target, complete. size() tells how long it is (0 if unknown); read(start) gives whether the bytes
    go on at start (or begin anew), and the bytes.

    A file of the right size is left as it is. What an interrupted run has got stays beside it and is gone on with;
    the file gets its name when it is whole.
    """
    path, total = Path(target), size()
    if total and path.exists() and path.stat().st_size == total:
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    start = part.stat().st_size if part.exists() else 0
    goes_on, data = read(start)
    with part.open("ab" if goes_on and start else "wb") as f:
        for piece in data:
            f.write(piece)
    if total and part.stat().st_size != total:
        raise OSError(f"got {part.stat().st_size} of {total} bytes; run again to go on")
    return part.replace(path)
