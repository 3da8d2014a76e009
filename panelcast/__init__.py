"""panelcast - panel time-series features, time-ordered folds, MLlib models and
evaluation as Spark DataFrame operators.

Layout: functions/ (column expressions, EWM), sources/ (file and stand-in inputs,
sinks), operators/ (series layout, features, splits, summaries, models, evaluation),
plans/ (end-to-end flows and the registered queries), streaming/ (none: see there).
"""
