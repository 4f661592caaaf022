"""labelflow: text-classification data operations (curation, sampling, scoring, metrics,
OOD flagging, drift, active learning) as Spark DataFrame jobs."""

__version__ = "0.1.0"
