"""labelflow.streaming."""
