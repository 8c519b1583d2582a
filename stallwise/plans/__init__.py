"""End-to-end dataflows put together from the operators."""
