"""Weighted survey statistics, panel event studies, spending crosswalks and
composition series as Spark DataFrame plans."""
