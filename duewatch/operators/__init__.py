"""DataFrame → DataFrame jobs. All take an explicit ``as_of`` where time matters."""
