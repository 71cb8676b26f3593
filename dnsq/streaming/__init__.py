"""Continuous forms of the detectors and of the flow builder."""
