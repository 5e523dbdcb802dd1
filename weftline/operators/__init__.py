"""DataFrame operators: dialogue, corpus preparation, splits, evaluation statistics, logs and ordered folds."""
