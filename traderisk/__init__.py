"""Trade-risk analytics on Spark: typed sources, a feature pipeline, warehouse
views, rule/model deal scoring, dashboards and look-ups — all DataFrame plans."""

__version__ = "0.1.0"
