"""Operators composed into scoring, training and retention reports."""
