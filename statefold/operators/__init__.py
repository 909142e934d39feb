"""State tables as folds of changelogs, and what is asked of them."""
