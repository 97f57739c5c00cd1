"""The raw layer kept up to date as files arrive."""
