"""Reading declared tables."""

from mixframe.sources.dataset import dataset, dataset_or_fallback, densify, select_roles, split_labels

__all__ = ["dataset", "dataset_or_fallback", "densify", "select_roles", "split_labels"]
