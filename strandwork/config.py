"""Settings of a run, read from an INI file."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, fields

from .constants import LONG_FRAGMENT, SHORT_FRAGMENT

#: Keys of the section ``main`` by field.
KEYS = {
    "long": "fragRangeLong",
    "short": "fragRangeShort",
    "motifs": "pwmFile",
    "dyads": "nucleosomeFile",
    "sites": "tfFile",
    "fasta": "nucFile",
    "fragments": "bamFile",
    "sizes": "chrSizesFile",
    "gtf": "gtfFile",
    "tech": "tech",
}


@dataclass(frozen=True)
class Config:
    long: tuple[int, int] = LONG_FRAGMENT
    short: tuple[int, int] = SHORT_FRAGMENT
    motifs: str | None = None
    dyads: str | None = None
    sites: str | None = None
    fasta: str | None = None
    fragments: str | None = None
    sizes: str | None = None
    gtf: str | None = None
    tech: str = "MNase"

    @property
    def offset(self) -> int:
        from .constants import ATAC_OFFSET

        return ATAC_OFFSET if self.tech.upper() == "ATAC" else 0


def parse(text: str) -> Config:
    """Keys that a config doesn't know are left out; ranges are two numbers in any brackets."""
    ini = configparser.ConfigParser()
    ini.read_string(text)
    main, found = ini["main"], {}
    for f in fields(Config):
        value = main.get(KEYS[f.name])
        if value is not None:
            found[f.name] = tuple(int(x) for x in re.findall(r"-?\d+", value))[:2] if f.name in ("long", "short") else value.strip()
    return Config(**found)
