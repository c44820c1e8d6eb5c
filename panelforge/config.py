"""Defaults of the analyses."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # fixed values: the analyses' published defaults
    win_length: int = 30
    win_step: int = 4
    n_states: int = 5
    taper_alpha: float = 0.75
    folds: int = 10
    screen_p: float = 0.005
    cca_reg: float = 1000.0
    cca_n_cc: tuple = (2, 3, 4, 5, 6, 7, 8, 9)
    cca_folds: int = 3
    permutations: int = 10_000
    svc_exponents: tuple = tuple(range(-20, 5))
    svc_iterations: int = 10_000
    svc_tolerance: float = 1e-5
    logistic_cs: tuple = tuple(x / 10 for x in range(1, 21))
    forest_depths: tuple = (None, 2, 4, 6, 8, 10)
    forest_splits: tuple = (0.025, 0.2, 10)  # shares of the columns, from, to, and how many
    sparsity_exponents: tuple = tuple(x / 2 for x in range(-14, 14))
    forest_trees: int = 2000
    selection_trees: int = 5000
    isolation_trees: int = 1000


DEFAULTS = Defaults()
