"""Runnable jobs over tables; each has a command line and a small configuration file."""
