"""Reusable operators: functions from data frames to data frames."""
