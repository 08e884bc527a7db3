"""Study settings: typed, with defaults, read from and written to INI text.

A null ``short_ms`` or ``smooth_weight`` is looked for in the data; null cut-offs and rates leave samples as they are.
"""

from __future__ import annotations

import configparser
import io
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    suffix: str = ".auto"
    data_type: str = "raw"
    low_hz: float | None = 1.0
    high_hz: float | None = 40.0
    filter_method: str = "fir"
    resample_hz: float | None = None
    channels_to_remove: tuple[str, ...] = ()
    points: str = "peaks"
    points_percent: float = 50.0
    method: str = "dot"
    k: int | None = None
    k_min: int = 2
    k_max: int = 10
    criterion: str = "majority_vote"
    repeats: int = 5
    max_rounds: int = 500
    tolerance: float = 1e-6
    labels: tuple[str, ...] = ("A", "B", "C", "D", "E", "F", "G")
    threshold: float | None = 0.5
    backfit_to: str = "all"
    filter: str = "replace_high"
    short_ms: float | None = 20.0
    smooth_half: int = 3
    smooth_weight: float | None = 5.0
    smooth_tolerance: float = 1e-6
    rejection: str = "reject"
    features: tuple[str, ...] = ("COV", "OCC", "DUR", "TP")
    duration_method: str = "geometric"
    window_s: float | None = None
    around: str = "none"
    trial_start_ms: float = -1000.0
    pre_from_ms: float = -1000.0
    pre_to_ms: float = -10.0
    post_from_ms: float = 20.0
    post_to_ms: float = 1000.0
    permutations: int = 2000
    pairwise_cap: int | None = 2000
    random_seed: int | None = 42

    def __post_init__(self):
        if self.k_min < 2 or self.k_max < self.k_min:
            raise ValueError("k_min must be 2 or more and k_max no less")
        if self.filter not in ("remove", "replace_high", "replace_half", "smooth", "none"):
            raise ValueError(f"unknown filter {self.filter!r}")
        for name, known in (
            ("rejection", ("reject", "flag")),
            ("backfit_to", ("all", "peaks")),
            ("data_type", ("raw", "epoched")),
            ("filter_method", ("fir", "iir", "fft")),
            ("around", ("none", "trial", "pooled")),
            ("duration_method", ("geometric", "arithmetic", "median", "trimmed")),
        ):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}")
        if self.around != "none" and (self.data_type != "epoched" or self.window_s):
            raise ValueError("features around an event need epoched data, without sliding windows")

    @property
    def keys(self) -> tuple[str, ...]:
        """What a sequence is: a recording, or each trial of one."""
        return ("recording_id", "trial") if self.data_type == "epoched" else ("recording_id",)


_OFF = ("", "none", "false", "no", "off")
_LISTS = {f.name for f in fields(Settings) if str(f.type).startswith("tuple")}


def _parse(name: str, text: str, default):
    text = text.strip()
    if name in _LISTS:
        return tuple(x.strip() for x in text.split(",") if x.strip())
    if text.lower() in _OFF and "None" in str(Settings.__dataclass_fields__[name].type):
        return None
    kind = str(Settings.__dataclass_fields__[name].type).split(" | ")[0]
    return {"int": int, "float": float, "str": str}[kind](text)


def loads(text: str) -> Settings:
    """Settings from INI text; unknown names raise."""
    p = configparser.ConfigParser()
    p.read_string(text)
    given = {k: v for s in p.sections() for k, v in p.items(s)}
    if unknown := set(given) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    base = Settings()
    return replace(base, **{k: _parse(k, v, getattr(base, k)) for k, v in given.items()})


def dumps(s: Settings) -> str:
    p = configparser.ConfigParser()
    p["study"] = {k: ", ".join(v) if isinstance(v, tuple) else "none" if v is None else str(v) for k, v in asdict(s).items()}
    out = io.StringIO()
    p.write(out)
    return out.getvalue()
