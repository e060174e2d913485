"""Walkers: one for each container format, from bytes to parts. What parts mean and which stay is told by SQL in ``partwise.operators``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from partwise.walkers.audio import flac, mp3, ogg, wav
from partwise.walkers.images import gif, jpeg, png, webp
from partwise.walkers.markup import svg
from partwise.walkers.media import heif, video
from partwise.walkers.part import Damaged, Part
from partwise.walkers.tiff import tiff
from partwise.walkers.zipped import zipped


Walker = Callable[[bytes, list[str]], Iterator[Part]]

WALKERS: dict[str, Walker] = {
    "jpeg": jpeg, "png": png, "webp": webp, "gif": gif, "tiff": tiff, "wav": wav, "flac": flac, "mp3": mp3, "ogg": ogg,
    "mp4": video, "mov": video, "avif": heif, "heic": heif, "heif": heif, "zip": zipped, "svg": svg,
}

__all__ = ["WALKERS", "Damaged", "Part"]
