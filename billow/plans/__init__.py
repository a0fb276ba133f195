"""Query plans over the warehouse tables."""
