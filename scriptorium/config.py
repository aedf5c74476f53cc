"""Settings of the corpus operators; values become literals of the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Directories that hold no documents.
IGNORED_DIRS = (".git", ".venv", "venv", "node_modules", "__pycache__", ".idea", ".mypy_cache", ".pytest_cache")


@dataclass(frozen=True)
class AdmissionConfig:
    suffixes: tuple[str, ...] = (".md", ".markdown")
    max_bytes: int = 2 * 1024 * 1024
    min_bytes: int = 1
    block_secret_filenames: bool = True
    scan_content_for_secrets: bool = True
    ignored_dirs: tuple[str, ...] = IGNORED_DIRS

    def __post_init__(self):
        if self.max_bytes < 1 or self.min_bytes < 0 or self.min_bytes > self.max_bytes:
            raise ValueError("0 <= min_bytes <= max_bytes and max_bytes >= 1 are needed")


@dataclass(frozen=True)
class FilterConfig:
    enabled: bool = True
    min_chars: int = 10
    drop_duplicates: bool = True

    def __post_init__(self):
        if self.min_chars < 0:
            raise ValueError("min_chars must not be negative")


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "fixed_lines"
    max_lines: int = 50
    filter: FilterConfig = field(default_factory=FilterConfig)

    def __post_init__(self):
        if self.max_lines < 1:
            raise ValueError("max_lines must be at least 1")


@dataclass(frozen=True)
class ImportConfig:
    chunk: ChunkConfig = field(default_factory=lambda: ChunkConfig(strategy="markdown_heading"))
    admission: AdmissionConfig = field(default_factory=AdmissionConfig)
    max_removal_ratio: float = 0.5
    processing_timeout_seconds: int = 1800

    def __post_init__(self):
        if not 0 <= self.max_removal_ratio <= 1:
            raise ValueError("max_removal_ratio must be between 0 and 1")
        if self.processing_timeout_seconds < 0:
            raise ValueError("processing_timeout_seconds must not be negative")
