"""Tests of the training-data operators (a package, so its conftest does not hide the one above)."""
