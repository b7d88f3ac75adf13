"""The two monthly jobs, one function per step."""
