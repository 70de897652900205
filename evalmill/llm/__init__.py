"""Operators over the text that language models are trained on and produce."""
