"""The study's constants, as one value that every job takes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Labels in canonical order, with the abbreviations that columns use.
    labels: tuple[str, ...] = ("Makrophage", "Lymphozyt", "NeutrophilerGranulozyt", "EosinophilerGranulozyt")
    short: tuple[str, ...] = ("Mac", "Lym", "Neu", "Eos")
    reference: int = 1  # the label that additive log-ratios divide by
    confidence: float = 0.44
    iou: float = 0.45
    distance: float = 20.0
    center_k: float = 2.0
    edge: int = 5
    tile: int = 640
    grid_tolerance: float = 0.99
    overlaps: tuple[float, ...] = (0.0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.25, 0.50)
    block_sizes: tuple[int, ...] = (1, 2, 3, 4, 5, 0)  # 0: the whole slide
    min_cells: int = 500
    mask_method: str = "none"
    draws: int = 1000
    alpha: float = 0.05
    seed: int = 20260501
    margin: float = 0.20
    tail: float = 0.95
    common_total: float = 1000.0

    def stride(self, overlap: float) -> int:
        """Pixels between tile origins."""
        return max(round(self.tile * (1 - overlap)), 1)


CONFIG = Config()
SCOPES = ("grid_n1", "grid_n2", "grid_n3", "grid_n4", "grid_n5", "global")
FAMILIES = ("iou", "iou_edgecrop", "nn_dist", "nn_center", "nn_cluster")
#: The 31 variants: no suppression, and each family at each scope.
METHODS = ("none", *(f"{f}_{s}" for f in FAMILIES for s in SCOPES))
#: Without edge cropping.
METHODS_25 = tuple(m for m in METHODS if not m.startswith("iou_edgecrop"))


def family_scope(method: str) -> tuple[str, str]:
    family, _, scope = next((method.partition(f"_{s}")[0], "", s) for s in SCOPES if method.endswith(f"_{s}"))
    return family, scope
