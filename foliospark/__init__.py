"""Monthly account-portfolio analytics as plain Spark DataFrame jobs."""
