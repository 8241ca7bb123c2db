"""Consumer-panel analytics as DataFrame transforms."""
