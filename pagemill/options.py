"""Options of the extraction job."""

from __future__ import annotations

from dataclasses import dataclass

MEDIA_TYPES = ("images", "videos", "audio")


@dataclass(frozen=True)
class ExtractOptions:
    media_types: tuple[str, ...] = MEDIA_TYPES
    text_only: bool = False
    preserve_structure: bool = False
    crawl: bool = False
    crawl_limit: int | None = None
    enable_quality_filter: bool = False
    quality_threshold: float = 0.6
    use_semantic_quality: bool = True
    link_mode: str = "reference"
    #: URL that media resolve against; None: each page's own.
    media_base: str | None = None

    def effective_media_types(self) -> tuple[str, ...]:
        """Text-only wins over any media types that were also asked for."""
        if self.text_only:
            return ()
        return tuple(m.strip().lower() for m in self.media_types)
