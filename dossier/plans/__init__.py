"""End-to-end plans: corpus stages, registered queries and their SQL."""
