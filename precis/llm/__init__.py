"""Operators for training-data pipelines (see the README, "Training-data operators").

Nothing else in the library imports this subpackage.
"""
