"""Settings of a prediction run; an explicit 0 counts, only a missing value takes the default."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class PredictionConfig:
    """One run over many slides with several models; the lists of models have one length."""

    test_images: list[str]
    model_path: list[str]
    prediction_class: list[str]
    model_tag: list[str] = field(default_factory=lambda: ["instance-model"])
    model_architecture: str = "regnet"
    model_encoder: str = "efficientnet-b2"
    threshold: list[float] = field(default_factory=lambda: [0.5])
    size_filter: list[float] = field(default_factory=lambda: [0])
    tile_size: int = 1024
    tile_overlap: float = 0.5
    edge_thresh: float = 0.9
    downsampling: float = 1
    n_channels: int | None = None
    train_channels: list[int] | None = None
    qp_type: str = "annotation"
    prediction_area_name: str = "train-area"
    tissue_rois: list[str | None] | None = None
    rev_class_dict: dict[int, str] | None = None
    post_scaling: float = 1

    def __post_init__(self) -> None:
        many = len(self.model_path)
        for name in ("model_tag", "threshold", "size_filter", "prediction_class"):
            given = getattr(self, name)
            if len(given) == 1 and many > 1 and name != "prediction_class":
                object.__setattr__(self, name, given * many)
            elif len(given) != many:
                raise ValueError(f"{name} has {len(given)} entries for {many} models")
        if self.tissue_rois is None:
            object.__setattr__(self, "tissue_rois", [None] * len(self.test_images))
        elif len(self.tissue_rois) != len(self.test_images):
            raise ValueError("every image needs its own entry in tissue_rois, null for none")
        if self.train_channels is not None:
            object.__setattr__(self, "n_channels", len(self.train_channels))


@dataclass(frozen=True)
class TrainingConfig:
    """One training set over many slides, each with its file of regions and, where it has negatives, its negative regions."""

    train_images: list[str]
    train_rois: list[str]
    valid_images: list[str] = field(default_factory=list)
    valid_rois: list[str] = field(default_factory=list)
    train_class: str = "train-area"
    negative_roi: str | None = None
    neg_proportion: float = 0.5
    offset_to_train_area: bool = False
    reload_from_pickle: str | None = None
    solver_steps: list[int] = field(default_factory=list)
    data_dir: str | None = None
    tile_size: int = 1024
    tile_overlap: float = 0.5
    edge_thresh: float = 0.95
    downsampling: float = 1
    train_channels: list[int] | None = None

    def __post_init__(self) -> None:
        for images, rois in ((self.train_images, self.train_rois), (self.valid_images, self.valid_rois)):
            if len(images) != len(rois):
                raise ValueError(f"{len(images)} images have {len(rois)} files of regions")
        if not 0 <= self.neg_proportion:
            raise ValueError("neg_proportion must not be below 0")


def _given(kind: type, values: dict[str, Any]) -> Any:
    """Settings from a mapping; unknown keys are passed over, nulls take the default, single values become lists."""
    known = {f.name: f for f in fields(kind)}
    given = {k: v for k, v in values.items() if k in known and v is not None}
    return kind(**{k: [v] if str(known[k].type).startswith("list[") and not isinstance(v, list) else v for k, v in given.items()})


def from_mapping(values: dict[str, Any]) -> PredictionConfig:
    """Settings of a prediction run from a mapping; unknown keys are passed over, nulls take the default, single values become lists."""
    return _given(PredictionConfig, values)


def read_config(path: str) -> PredictionConfig:
    """Settings of a prediction run from a YAML file."""
    return _given(PredictionConfig, _yaml(path))


def read_training_config(path: str) -> TrainingConfig:
    """Settings of a training set from a YAML file."""
    return _given(TrainingConfig, _yaml(path))


def _yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path) as file:
        return yaml.safe_load(file)
