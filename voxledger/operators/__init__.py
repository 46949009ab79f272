"""voxledger.operators"""
