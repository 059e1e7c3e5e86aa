"""Whole workflows: training, prediction and evaluation."""
