"""End-to-end jobs put together from the operators."""
