"""labelflow.functions."""
