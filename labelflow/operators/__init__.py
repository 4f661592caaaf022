"""labelflow.operators."""
