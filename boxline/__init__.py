"""Ticket-sales analytics expressed as Spark DataFrame operators."""
