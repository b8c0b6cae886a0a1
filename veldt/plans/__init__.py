"""Plan-level building blocks: durable materialisation and the vertex-program loop."""
